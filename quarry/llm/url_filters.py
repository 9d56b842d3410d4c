"""URL filters by a sort-merge range join over reversed-host keys.

A rule is (host, path, verdict). It fits its host and all subdomains when the URL's path starts with the rule's path;
the longest rule (host plus path) wins, then the one with the longer host, then block before allow.

Method. A host's key is its labels in reverse, each followed by a dot: m.example.net gives ``net.example.m.``. All keys
that a rule host covers lie in the interval [``net.example.``, ``net.example/``), since ``/`` follows ``.``; intervals of
nested hosts nest. The stack of rules that is in force changes only where an interval opens or closes, so each boundary
carries the frame (the stack) that holds from there on. URLs and boundaries are sorted together and one sweep hands every
URL the frame of the last boundary at or before it; the path decides within the frame.

Scale. Only keys, hosts and paths are shuffled, once. The key range is cut into blocks of boundaries, and a block into as
many salted sweeps as its URLs need, each with its own copy of the block's boundaries, so a hot host spreads over many
tasks. Everything is DataFrame code.

Defined cases: a null URL or one without ``://`` has empty host and path; a URL that no rule fits gets the default verdict
and a null rule; rules with a null or empty host fit nothing and a null rule path counts as empty; repeated URLs and rules
are judged alike; an empty table gives no rows. Columns of the input are read only where they are named in ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import interval_of
from quarry.session import default_parallelism

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_SCHEMA = "host string, path string, verdict string"
#: Boundaries in a block at least, and blocks at most: the splitters are a literal, so their number is bounded.
BLOCK_BOUNDARIES, MOST_BLOCKS = 4096, 1024
#: URLs that one salted sweep should hold at most, about.
SWEEP_URLS = 2_000_000


def with_host_and_path(pages: DataFrame, url: str) -> DataFrame:
    """Add host and path, parsed from the URL column."""
    at = F.instr(F.col(url), "://")
    rest = F.col(url).substr(at + 3, F.length(url))
    has = F.col(url).isNotNull() & (at > 0)
    return pages.select(
        "*",
        F.when(has, F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)).otherwise("").alias("host"),
        F.when(has, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("").alias("path"),
    )


def host_key(host: Column) -> Column:
    """Reversed-host canonical key."""
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), "."), F.lit("."))


def boundaries(rules: DataFrame) -> DataFrame:
    """Where the stack of rules in force changes: key, and the frame that holds from there on."""
    own = (
        rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .filter(F.col("host") != "")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(
            host_key(F.col("host")).alias("node"),
            F.struct(
                (F.length("host") + F.length("path")).alias("long"),
                F.length("host").alias("host_long"),
                "verdict",
                F.concat("host", "path").alias("rule"),
                "path",
            ).alias("entry"),
        )
        .groupBy("node")
        .agg(F.collect_list("entry").alias("entries"))
    )
    labels = F.split(F.expr("substr(node, 1, length(node) - 1)"), "[.]")
    above = own.select(
        "node",
        F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))).alias("up"),
    )
    frames = (
        above.join(own.select(F.col("node").alias("up"), F.col("entries")), "up")
        .groupBy("node")
        .agg(
            F.flatten(F.collect_list("entries")).alias("whole"),
            F.flatten(F.collect_list(F.when(F.col("up") != F.col("node"), F.col("entries")))).alias("outer"),
        )
    )
    return frames.select(
        F.explode(
            F.array(
                F.struct(F.col("node").alias("key"), F.col("whole").alias("frame")),
                F.struct(F.concat(F.expr("substr(node, 1, length(node) - 1)"), F.lit("/")).alias("key"), F.col("outer").alias("frame")),
            )
        ).alias("edge")
    ).select("edge.*")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow") -> DataFrame:
    """One row per row of pages: the columns in keep, host, path, rule, verdict."""
    spark = pages.sparkSession
    edges = boundaries(rules)
    urls = with_host_and_path(pages.select(*[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)], F.col(url).alias("_url")), "_url")
    urls = urls.select(*[f"_keep_{i}" for i in range(len(keep))], "host", "path", host_key(F.col("host")).alias("key"))

    n = edges.count()
    blocks = min(MOST_BLOCKS, -(-n // BLOCK_BOUNDARIES))
    splitters: list[str] = []
    if blocks > 1:
        dealt = edges.select("key").repartitionByRange(blocks, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("key"))
        splitters = sorted(r.key for r in dealt.collect())[1:]
    block = interval_of(F.col("key"), splitters)
    least = 4 * default_parallelism(spark)
    salts = [least]
    if splitters:
        counted = {r.block: r["count"] for r in urls.groupBy(block.alias("block")).count().collect()}
        total = max(1, sum(counted.values()))
        salts = [max(1, -(-counted.get(b, 0) * least // total), -(-counted.get(b, 0) // SWEEP_URLS)) for b in range(len(splitters) + 1)]
    salt_count = F.get(F.array(*map(F.lit, salts)), F.col("block"))
    points = urls.withColumn("block", block).withColumn(
        "salt", F.pmod(F.xxhash64(*[f"_keep_{i}" for i in range(len(keep))], "host", "path"), salt_count).cast("int")
    )
    copies = edges.withColumn("block", block).withColumn("salt", F.explode(F.sequence(F.lit(0), salt_count - 1)))
    swept = points.withColumn("kind", F.lit(1)).unionByName(copies.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    sweep = Window.partitionBy("block", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    judged = swept.withColumn("stack", F.last("frame", ignorenulls=True).over(sweep)).filter("kind = 1")
    fits = F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["long"].alias("a"), r["host_long"].alias("b"), r["verdict"].alias("verdict"), r["rule"].alias("rule"))))
    return judged.select(
        *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)], "host", "path", best["rule"].alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict")
    )

"""Data checks as DataFrames of violations (empty when all is well), and require() to turn one into an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def missing(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows with a null or blank in one of the columns."""
    return rows.filter(reduce(lambda a, b: a | b, (F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "" for c in columns)))


def wrong_count(rows: DataFrame, expected: int) -> DataFrame:
    """One row with n and expected if the number of rows differs."""
    return rows.agg(F.count(F.lit(1)).alias("n")).withColumn("expected", F.lit(expected)).filter("n <> expected")


def absent_columns(rows: DataFrame, *columns: str) -> list[str]:
    return [c for c in columns if c not in rows.columns]


def clashing_columns(rows: DataFrame, *columns: str) -> list[str]:
    """Columns that are about to be added but exist."""
    return [c for c in columns if c in rows.columns]


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, repeats counted, with the side they are on."""
    left, right = a.exceptAll(b.select(a.columns)), b.select(a.columns).exceptAll(a)
    return left.withColumn("side", F.lit("left")).unionByName(right.withColumn("side", F.lit("right")))


def not_a_partition(whole: DataFrame, parts: list[DataFrame], key: str) -> DataFrame:
    """Keys that are not in exactly one of the parts as often as in the whole."""
    split = reduce(DataFrame.unionByName, (p.select(key, F.lit(i).alias("part")) for i, p in enumerate(parts)))
    have = split.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("part").alias("parts"))
    want = whole.groupBy(key).agg(F.count(F.lit(1)).alias("expected"))
    both = want.join(have, key, "full_outer").na.fill(0, ["n", "parts", "expected"])
    return both.filter("n <> expected OR parts > 1")


def lost(stages: DataFrame, source: str, total: DataFrame) -> DataFrame:
    """Sources whose stage counts do not add up to their input. stages: source, stage, n. total: source, n."""
    have = stages.groupBy(source).agg(F.sum("n").alias("have"))
    return total.join(have, source, "full_outer").na.fill(0, ["n", "have"]).filter("n <> have")


def changed(a: DataFrame, b: DataFrame, key: str, *columns: str) -> DataFrame:
    """Keys whose listed columns differ, nulls being equal, and keys that one side lacks."""
    left = a.select(key, F.struct(*columns).alias("_a"))
    right = b.select(key, F.struct(*columns).alias("_b"))
    return left.join(right, key, "full_outer").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(key)


def content_digest(rows: DataFrame, key: str, value: Column) -> DataFrame:
    """One row: number of rows and an order-independent digest of (key, value). Two sums of row hashes under different seeds
    make it, exact in 38 digits, so repeated rows count as often as they occur; nulls are told apart from empty texts."""
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(seed), F.col(key), F.col(key).isNull(), value, value.isNull()).cast("decimal(28,0)")), F.lit(0)).cast("string") for seed in (1, 2)]
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws(":", *sums), 256).alias("digest"))


def config_differences(a, b, path: str = "", ignored: frozenset[str] = frozenset()) -> list[str]:
    """Where two nested configurations (dicts, lists, values) differ, by path, as messages; ignored paths are passed over."""
    if path in ignored:
        return []
    if isinstance(a, dict) and isinstance(b, dict):
        lacking = [f"{path}.{k}".lstrip(".") + (": only in the first" if k in a else ": only in the second") for k in sorted(a.keys() ^ b.keys(), key=str)]
        lacking = [x for x in lacking if x.split(":")[0] not in ignored]
        return lacking + [x for k in sorted(a.keys() & b.keys(), key=str) for x in config_differences(a[k], b[k], f"{path}.{k}".lstrip("."), ignored)]
    if isinstance(a, list) and isinstance(b, list) and len(a) == len(b):
        return [x for i, (p, q) in enumerate(zip(a, b)) for x in config_differences(p, q, f"{path}[{i}]", ignored)]
    return [] if type(a) is type(b) and a == b else [f"{path or '.'}: {a!r} is not {b!r}"]


def over_budget(rows: DataFrame, key: str, parts: list[str], limit: Column) -> DataFrame:
    """Keys whose token counts (null counts nothing) are negative or add up to more than their limit, with the sum."""
    counts = [F.coalesce(F.col(p), F.lit(0)) for p in parts]
    total = reduce(lambda a, b: a + b, counts)
    return rows.select(key, total.alias("total"), limit.alias("limit"), F.least(*counts, F.lit(0)).alias("_least")).filter("total > limit OR _least < 0").drop("_least")


def require(violations: DataFrame, what: str) -> None:
    """ValueError with a few examples unless there are no violations."""
    if found := violations.limit(3).collect():
        raise ValueError(f"{what}: {[r.asDict() for r in found]}")

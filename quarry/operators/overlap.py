"""n-gram decontamination: how much of each evaluation item a training row holds, and what follows from it.

Coverage of an item by a row is the share of the item's distinct n-grams that the row has; one score per pair, never pooled
over items. Rows at or above the threshold for some item are removed; rows whose best score lies in the band below are near
misses. Items shorter than n tokens are found as substrings of the normal form instead (coverage 1).

n-grams are 64-bit hashes (of 10^13 n-grams of rows and 10^5 of items less than one pair is expected to clash, and a clash
is one n-gram of one item). The row side is exploded to (id, gram) and joined with the items' grams before any aggregate, so only shared grams are
shuffled; the optimizer broadcasts the item side while it is small and joins by shuffle beyond. Short items are a stated
query set: they travel as literal arrays, in blocks, and each row is looked at once.

Null and empty texts share nothing; repeated rows count as one row of their id; an item whose normal form is empty is an
error (assert_true at run time); empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T

N, THRESHOLD, NEAR = 8, 0.7, 0.5
#: Short items in one literal array.
BLOCK = 500


def validate(n: int, threshold: float, near: float) -> None:
    """Settings that make sense, or ValueError."""
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise ValueError("n must be a positive integer")
    if not 0 <= near < threshold <= 1:
        raise ValueError("need 0 <= near < threshold <= 1")


def _short_matches(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(id, eval_set, item_id, coverage, matched, total, method) of short items inside rows' normal forms."""
    known = sorted((r.eval_set, r.item_id, r.normal) for r in items.select("eval_set", "item_id", "normal").collect())
    found = [F.array().cast("array<struct<s:string,i:bigint,n:string>>")]
    for at in range(0, len(known), BLOCK):
        block = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(i).cast("long").alias("i"), F.lit(n).alias("n")) for s, i, n in known[at : at + BLOCK]])
        found.append(F.filter(block, lambda m: F.contains(F.col("normal"), m["n"])))
    out = rows.select("id", F.explode(F.concat(*found)).alias("m"))
    return out.select("id", F.col("m.s").alias("eval_set"), F.col("m.i").alias("item_id"), F.lit(1.0).alias("coverage"), F.lit(0).cast("long").alias("matched"), F.lit(0).cast("long").alias("total"), F.lit("short_exact_substring").alias("method")).distinct()


def matches(rows: DataFrame, items: DataFrame, n: int = N, normal=T.normal_v2) -> DataFrame:
    """Every scored pair. rows: id, text. items: eval_set, item_id, text."""
    items = items.select("eval_set", "item_id", normal(F.col("text")).alias("normal"))
    checked = items.withColumn("normal", F.when(F.col("normal") != "", F.col("normal")).otherwise(F.raise_error(F.lit("an evaluation item has an empty normal form"))))
    own = checked.select("eval_set", "item_id", "normal", F.array_distinct(T.gram_hashes(T.words(F.col("normal")), n)).alias("grams")).withColumn("total", F.size("grams").cast("long"))
    rows = rows.select("id", normal(F.coalesce("text", F.lit(""))).alias("normal"))
    left = rows.select("id", F.explode(T.gram_hashes(T.words(F.col("normal")), n)).alias("gram"))  # distinct only after the join
    right = own.select("eval_set", "item_id", "total", F.explode("grams").alias("gram"))
    shared = left.join(right, "gram")
    scored = shared.groupBy("id", "eval_set", "item_id", "total").agg(F.count_distinct("gram").alias("matched"))
    long = scored.select("id", "eval_set", "item_id", (F.col("matched") / F.col("total")).alias("coverage"), "matched", "total", F.lit("ngram_coverage").alias("method"))
    return long.unionByName(_short_matches(rows, own.filter("total = 0")))


def best(scored: DataFrame) -> DataFrame:
    """The first match of each row by (-coverage, eval_set, item as text)."""
    order = Window.partitionBy("id").orderBy(F.desc("coverage"), "eval_set", F.col("item_id").cast("string"))
    return scored.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def status(rows: DataFrame, scored: DataFrame, threshold: float = THRESHOLD, near: float = NEAR) -> DataFrame:
    """Each row's id with best_coverage and status: removed, near_miss or kept."""
    validate(1, threshold, near)
    top = scored.groupBy("id").agg(F.max("coverage").alias("best_coverage"))
    told = F.when(F.col("best_coverage") >= threshold, "removed").when(F.col("best_coverage") >= near, "near_miss").otherwise("kept")
    return rows.join(top, "id", "left").withColumn("status", told)


def removal_counts(scored: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Removed rows for each evaluation set, each row once per set, zero for sets that remove none."""
    counted = scored.filter(F.col("coverage") >= threshold).groupBy("eval_set").agg(F.count_distinct("id").alias("removed"))
    return items.select("eval_set").distinct().join(counted, "eval_set", "left").select("eval_set", F.coalesce("removed", F.lit(0)).alias("removed"))


def kept(rows: DataFrame, scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows without a match at the threshold, as they are."""
    return rows.join(scored.filter(F.col("coverage") >= threshold).select("id").distinct(), "id", "left_anti")


def number_variants(rows: DataFrame, items: DataFrame) -> DataFrame:
    """(id, eval_set, item_id) of rows whose lexical form equals an item's but for numbers."""
    form = T.normal_lexical(F.coalesce("text", F.lit("")))
    left = rows.select("id", form.alias("normal")).withColumn("template", T.numeric_template(F.col("normal")))
    right = items.select("eval_set", "item_id", form.alias("item_normal")).filter(F.col("item_normal").rlike(r"\p{Nd}")).withColumn("template", T.numeric_template(F.col("item_normal")))
    return left.join(right, "template").filter("normal <> item_normal").select("id", "eval_set", "item_id").distinct()


def reference_matches(rows: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """Lexical-form coverage together with number variants: id, eval_set, item_id, coverage, number_variant."""
    scored = matches(rows, items, n, T.normal_lexical).select("id", "eval_set", "item_id", "coverage")
    variants = number_variants(rows, items).withColumn("number_variant", F.lit(True))
    both = scored.join(variants, ["id", "eval_set", "item_id"], "full_outer")
    return both.select("id", "eval_set", "item_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("number_variant", F.lit(False)).alias("number_variant"))

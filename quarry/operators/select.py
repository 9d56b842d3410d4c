"""Selection: last write wins, hash ranks, quotas, caps, mixed groups, shuffles, and smoke samples.

Samplers rank by SHA-256, so they do not depend on a random generator, on row order or on partitions. Per-key picks are
min_by/max_by aggregates with partial aggregation where one row is wanted, and ranked windows where several are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import rank_key


def latest(rows: DataFrame, key: list[str], position: list[str]) -> DataFrame:
    """The last row of each key by position: an aggregate, so a hot key is combined before the shuffle."""
    return rows.groupBy(*key).agg(F.max_by(F.struct("*"), F.struct(*position)).alias("_last")).select("_last.*")


def first_of(rows: DataFrame, key: list[str], position: list[str]) -> DataFrame:
    """The first row of each key by position."""
    return rows.groupBy(*key).agg(F.min_by(F.struct("*"), F.struct(*position)).alias("_first")).select("_first.*")


def ranked(rows: DataFrame, key: str, identifier: Column, per: int | Column, seed: int) -> DataFrame:
    """The per rows of each key whose hash rank is least. A first cut within salted parts keeps a hot key from one task."""
    told = rows.withColumn("_rank", rank_key(seed, F.col(key).cast("string"), identifier.cast("string"))).withColumn("_id", identifier.cast("string"))
    part = Window.partitionBy(key, F.substring("_rank", 64, 1)).orderBy("_rank", "_id")
    whole = Window.partitionBy(key).orderBy("_rank", "_id")
    some = told.withColumn("_n", F.row_number().over(part)).filter(F.col("_n") <= per)
    return some.withColumn("_n", F.row_number().over(whole)).filter(F.col("_n") <= per).drop("_n", "_rank", "_id")


def share(rows: DataFrame, identifier: Column, seed: int, part: float) -> DataFrame:
    """About a given part of the rows, by a hash bucket."""
    bucket = F.conv(F.substring(rank_key(seed, identifier.cast("string")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.filter(bucket < part)


def shuffled(rows: DataFrame, identifier: Column, seed: int, step: int) -> DataFrame:
    """The rows with a place in a seeded order; places come from range-partitioned ranks, so no task holds all rows."""
    key = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(str(step)), identifier.cast("string")), 256)
    return rows.withColumn("rank", key).orderBy("rank")


def longest(rows: DataFrame, length: Column, position: str, n: int) -> DataFrame:
    """The n longest rows, ties by position (a top-k, so no full sort)."""
    return rows.withColumn("_length", length).orderBy(F.desc("_length"), position).limit(n).drop("_length")


def quotas(rows: DataFrame, stratum: str, identifier: Column, targets: dict[str, int], seed: int) -> DataFrame:
    """For each stratum its target number of rows by hash rank; strata without a target give none."""
    told = F.create_map(*[F.lit(v) for pair in targets.items() for v in pair])
    wanted = rows.withColumn("_quota", F.try_element_at(told, F.col(stratum))).filter("_quota IS NOT NULL")
    return ranked(wanted, stratum, identifier, F.col("_quota"), seed).drop("_quota")


def share_capped(rows: DataFrame, stratum: str, one: str, most: float, identifier: Column, seed: int) -> DataFrame:
    """All rows but those of one stratum beyond a share of the result: the second pass of stratified sampling."""
    others = rows.filter(~F.col(stratum).eqNullSafe(F.lit(one))).count()
    room = int(others * most / (1 - most))
    return ranked(rows.filter(F.col(stratum) == one), stratum, identifier, room, seed).unionByName(rows.filter(~F.col(stratum).eqNullSafe(F.lit(one))))


def mixed_groups(samples: DataFrame, group: str, order: str, size: int, batch: int, retained: int) -> DataFrame:
    """Per group in candidate order: batch, correct, mixed, accepted (among the first retained mixed ones) and whether its
    batch runs at all (no batch runs after the one in which the last wanted group is found).

    samples: group, order, correct. Groups of another size are left out. The running count is taken per batch and then
    over batches, so the window over all holds a row for each batch only."""
    per = samples.groupBy(group, order).agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("correct")).filter(F.col("n") == size)
    per = per.withColumn("mixed", (F.col("correct") > 0) & (F.col("correct") < size)).withColumn("batch", F.floor(F.col(order) / batch))
    batches = per.groupBy("batch").agg(F.count_if("mixed").alias("found"))
    before = F.sum("found").over(Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, -1))
    told = batches.select("batch", F.coalesce(before, F.lit(0)).alias("before"))
    within = Window.partitionBy("batch").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = F.col("before") + F.sum(F.col("mixed").cast("long")).over(within)
    out = per.join(told, "batch").withColumn("running", running)
    return out.select(group, order, "batch", "correct", "mixed", (F.col("mixed") & (F.col("running") <= retained)).alias("accepted"), (F.col("before") < retained).alias("ran"))


def rollout_stats(groups: DataFrame, size: int) -> DataFrame:
    """Totals over the batches that ran: candidate, mixed, all-correct, all-wrong groups, retained, acceptance rate."""
    return groups.filter("ran").agg(
        F.count(F.lit(1)).alias("candidates"),
        F.count_if("mixed").alias("mixed"),
        F.count_if(F.col("correct") == size).alias("all_correct"),
        F.count_if(F.col("correct") == 0).alias("all_wrong"),
        F.count_if("accepted").alias("retained"),
        F.try_divide(F.count_if("mixed").cast("double"), F.count(F.lit(1))).alias("acceptance_rate"),
    )


def minibatch_totals(rows: DataFrame, position: str, width: int, value: str) -> Column:
    """Sum of a value over each contiguous chunk of width positions."""
    return F.sum(value).over(Window.partitionBy(F.floor(F.col(position) / width)))


def pass_counts(rows: DataFrame, column: str, wanted: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Rows whose number of correct samples is one of the wanted; a value outside 0 to 8 is an error."""
    checked = F.when(F.col(column).between(0, 8), F.col(column)).otherwise(F.raise_error(F.lit("pass count outside 0 to 8")))
    return rows.filter(checked.isin(*wanted))


def preferred_first(rows: DataFrame, preferred: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows: those whose key is preferred, then others by hash rank (a top-k over both, so no full sort)."""
    wanted = preferred.select(key).distinct().withColumn("_wanted", F.lit(0))
    told = rows.join(wanted, key, "left").withColumn("_rank", rank_key(seed, F.col(key).cast("string")))
    return told.orderBy(F.coalesce("_wanted", F.lit(1)), "_rank").limit(n).drop("_wanted", "_rank")


def longest_and_fill(rows: DataFrame, dataset: str, identifier: str, length: Column, per: int, seed: int) -> DataFrame:
    """For each dataset its longest row (ties by id) and others by hash rank, per rows in all."""
    longest_row = rows.groupBy(dataset).agg(F.max_by(identifier, F.struct(length.alias("l"), (-F.col(identifier)).alias("i"))).alias(identifier))
    others = rows.join(longest_row, [dataset, identifier], "left_anti")
    return rows.join(longest_row, [dataset, identifier], "left_semi").unionByName(ranked(others, dataset, F.col(identifier), per - 1, seed))

"""Evaluation metrics: pass@k, rollups, histograms, percentiles, moving averages, comparisons, regrade and usage totals.

All are grouped aggregates with partial aggregation, or windows over series that are first aggregated to steps. Empty groups
give null means, never zero; "not evaluated" (null) stays null and is not counted as wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pass_at_k(n: Column, correct: Column, k: int) -> Column:
    """Unbiased pass@k, 1 - C(n-c, k) / C(n, k), as a product; null where k exceeds n."""
    product = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda a, i: a * ((n - correct - i) / (n - i)))
    return F.when(n < k, F.lit(None).cast("double")).when(n - correct < k, F.lit(1.0)).otherwise(1.0 - product)


def sample_metrics(records: DataFrame, by: list[str], ks: tuple[int, ...]) -> DataFrame:
    """Per group of by: problems, responses, avg (share correct), mean pass@k over problems that have k samples, and mean
    tokens of all, correct and incorrect responses. records: by, id, correct, tokens."""
    per = records.groupBy(*by, "id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("c"), F.sum("tokens").alias("t"), F.sum(F.when(F.col("correct"), F.col("tokens"))).alias("tc")
    )
    share = lambda a, b: F.when(b != 0, a / b)
    n, c, t, tc = F.sum("n"), F.sum("c"), F.sum("t"), F.sum("tc")
    tc0 = F.coalesce(tc, F.lit(0))
    return per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("problems"),
        n.alias("responses"),
        share(c, n).alias("avg"),
        *[F.avg(pass_at_k(F.col("n"), F.col("c"), k)).alias(f"pass_{k}") for k in ks],
        share(t, n).alias("tokens_all"),
        share(tc, c).alias("tokens_correct"),
        share(t - tc0, n - c).alias("tokens_incorrect"),
    )


def incomplete_groups(records: DataFrame, n: int) -> DataFrame:
    """Problems whose samples are not exactly the indices 0 to n - 1: the check before any metric."""
    per = records.groupBy("id").agg(F.count(F.lit(1)).alias("many"), F.count_distinct("sample_index").alias("distinct"), F.min("sample_index").alias("low"), F.max("sample_index").alias("high"))
    return per.filter((F.col("many") != n) | (F.col("distinct") != n) | (F.col("low") != 0) | (F.col("high") != n - 1))


def accuracy_rollup(records: DataFrame) -> DataFrame:
    """Accuracy by subject and overall for each benchmark, in one pass over grouping sets, and the unweighted mean of the
    subjects. records: benchmark, subject, correct, tokens, truncated."""
    rolled = (
        records.groupingSets([["benchmark", "subject"], ["benchmark"]], "benchmark", "subject")
        .agg(
            F.grouping("subject").alias("_all"),
            F.count(F.lit(1)).alias("problems"),
            F.count_if("correct").alias("correct"),
            (100 * F.avg(F.col("correct").cast("double"))).alias("accuracy"),
            F.avg("tokens").alias("tokens"),
            (100 * F.avg(F.col("truncated").cast("double"))).alias("truncated"),
        )
        .withColumn("subject", F.when(F.col("_all") == 1, F.lit("overall")).otherwise(F.col("subject")))
    )
    macro = rolled.filter("_all = 0").groupBy("benchmark").agg(F.sum("problems").alias("problems"), F.avg("accuracy").alias("accuracy"))
    macro = macro.select("benchmark", F.lit("task_macro").alias("subject"), "problems", F.lit(None).cast("long").alias("correct"), "accuracy", F.lit(None).cast("double").alias("tokens"), F.lit(None).cast("double").alias("truncated"))
    return rolled.drop("_all").unionByName(macro)


def instruction_accuracy(records: DataFrame, column: str) -> DataFrame:
    """Prompt level (all instructions followed) and instruction level accuracy from an array of booleans."""
    return records.agg(
        F.count(F.lit(1)).alias("prompts"),
        F.count_if(F.forall(column, lambda x: x)).alias("prompts_followed"),
        F.sum(F.size(column)).cast("long").alias("instructions"),
        F.sum(F.size(F.filter(column, lambda x: x))).cast("long").alias("instructions_followed"),
    )


def comparison(records: DataFrame, model: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """One row per model with a column for each benchmark. The columns are named, so no pass is spent to find them."""
    return records.groupBy(model).pivot(column, columns).agg(F.first(value))


def parent_deltas(rows: DataFrame, key: str, parent: str, value: str) -> DataFrame:
    """Each row's value less its parent's; null without a parent row."""
    above = rows.select(F.col(key).alias("_parent"), F.col(value).alias("_above"))
    return rows.join(above, F.col(parent) == F.col("_parent"), "left").select(key, parent, value, (F.col(value) - F.col("_above")).alias("delta"))


def histogram(rows: DataFrame, value: str, low: int, high: int) -> DataFrame:
    """Counts of each whole number from low to high, zero-filled."""
    axis = rows.sparkSession.range(low, high + 1).select(F.col("id").alias(value))
    counted = rows.groupBy(F.col(value).cast("long").alias(value)).agg(F.count(F.lit(1)).alias("n"))
    return axis.join(counted, value, "left").select(value, F.coalesce("n", F.lit(0)).alias("n"))


def sampling_summary(rows: DataFrame, selected: Column, samples: int = 8) -> DataFrame:
    """(metric, name, value) over all rows: how many there are and are selected, and of the selected ones the responses, a
    zero-filled histogram of num_correct, finish reasons, tokens, empty extractions and grading errors.

    rows: num_correct, finish_reasons, response_tokens, extracted_answers, grading_errors (arrays). Rows that are not
    selected (or null) count as such only; null arrays count nothing. One pass; sums are combined before the shuffle."""
    picked = F.coalesce(selected, F.lit(False))

    def entry(metric: str, value: Column, name: Column | None = None) -> Column:
        return F.struct(F.lit(metric).alias("metric"), (F.lit("") if name is None else name).alias("name"), F.coalesce(value.cast("long"), F.lit(0).cast("long")).alias("value"))

    own = [
        entry("responses", F.lit(samples)),
        *[entry("num_correct", F.col("num_correct") == i, F.lit(str(i))) for i in range(samples + 1)],
        entry("response_tokens", F.aggregate(F.coalesce("response_tokens", F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x.cast("long"), F.lit(0).cast("long")))),
        entry("empty_extractions", F.size(F.filter(F.coalesce("extracted_answers", F.array().cast("array<string>")), lambda x: x == ""))),
        entry("grading_errors", F.size(F.filter(F.coalesce("grading_errors", F.array().cast("array<string>")), lambda x: x.isNotNull()))),
    ]
    finish = F.transform(F.coalesce("finish_reasons", F.array().cast("array<string>")), lambda x: entry("finish_reasons", F.lit(1), F.coalesce(x, F.lit("null"))))
    none = F.filter(finish, lambda _: F.lit(False))
    every = F.array(entry("source_rows", F.lit(1)), entry("selected_rows", picked), entry("unselected_rows", ~picked))
    told = rows.select(F.explode(F.concat(every, F.when(picked, F.concat(F.array(*own), finish)).otherwise(none))).alias("e"))
    return told.groupBy("e.metric", "e.name").agg(F.sum("e.value").alias("value"))


def crosstab(rows: DataFrame, by: list[str], flags: list[str]) -> DataFrame:
    """Per group, how many rows each flag keeps and drops (a null flag drops)."""
    kept = {f: F.count_if(F.coalesce(F.col(f), F.lit(False))) for f in flags}
    return rows.groupBy(*by).agg(*[c for f, k in kept.items() for c in (k.alias(f"{f}_kept"), (F.count(F.lit(1)) - k).alias(f"{f}_dropped"))])


def grade_counts(rows: DataFrame, by: list[str], problem: str) -> DataFrame:
    """Rows and distinct problems of each grade."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(problem).alias("problems"))


def length_stats(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, sum, least, most, and median, p90 and p99 with linear interpolation (exact)."""
    p = lambda q: F.percentile(value, F.lit(q))
    return rows.groupBy(*by).agg(
        F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), p(0.5).alias("median"), p(0.9).alias("p90"), p(0.99).alias("p99"), F.max(value).alias("high")
    )


def moving_average(series: DataFrame, run: str, step: str, value: Column, width: int) -> Column:
    """Trailing mean over width steps of a run, shorter at the head."""
    return F.avg(value).over(Window.partitionBy(run).orderBy(step).rowsBetween(-(width - 1), 0))


def pooled_ratio(run: str, step: str, part: str, whole: str, width: int) -> Column:
    """Trailing sum of a part over trailing sum of a whole."""
    w = Window.partitionBy(run).orderBy(step).rowsBetween(-(width - 1), 0)
    return F.try_divide(F.sum(part).over(w).cast("double"), F.sum(whole).over(w).cast("double"))


def splice(original: DataFrame, recovered: DataFrame, step: str, last: int) -> DataFrame:
    """Steps of the original up to last, and of the recovered run beyond."""
    return original.filter(F.col(step) <= last).unionByName(recovered.filter(F.col(step) > last))


def gaps(series: DataFrame, run: str, step: str) -> DataFrame:
    """Steps that do not follow the one before them (nor start the run): none in a contiguous series."""
    before = F.lag(step).over(Window.partitionBy(run).orderBy(step))
    return series.withColumn("before", before).filter((F.col("before").isNotNull()) & (F.col(step) != F.col("before") + 1)).select(run, step, "before")


def edge_windows(series: DataFrame, run: str, step: str, part: str, whole: str, width: int) -> DataFrame:
    """Pooled ratio over the first and the last width steps of each run."""
    up, down = Window.partitionBy(run).orderBy(step), Window.partitionBy(run).orderBy(F.desc(step))
    ranked = series.withColumn("_u", F.row_number().over(up)).withColumn("_d", F.row_number().over(down))
    edge = lambda c: F.sum(F.when(c <= width, F.col(part))) / F.sum(F.when(c <= width, F.col(whole)))
    return ranked.groupBy(run).agg(F.count(F.lit(1)).alias("steps"), edge(F.col("_u")).alias("first_ratio"), edge(F.col("_d")).alias("last_ratio"))


def epoch_means(series: DataFrame, epoch: str, value: str) -> DataFrame:
    """Mean of a value per epoch, the epoch being the ceiling of the fractional one less a hair."""
    return series.groupBy(F.ceil(F.col(epoch) - 1e-8).alias("epoch_nr")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("records"))


def regrade_changes(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Totals before and after a regrade, and flags that changed, of two boolean arrays."""
    changed = F.size(F.filter(F.zip_with(old, new, lambda a, b: ~a.eqNullSafe(b)), lambda x: x))
    true = lambda c: F.size(F.filter(c, lambda x: x))
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(true(old)).cast("long").alias("old_correct"), F.sum(true(new)).cast("long").alias("new_correct"), F.sum(changed).cast("long").alias("changed_flags"), F.count_if(changed > 0).alias("changed_rows"))


def reward(correct: Column, length: Column, soft: int, most: int, factor: float = 1.0) -> Column:
    """1 or -1, less a penalty that grows linearly from the soft limit to the hard one."""
    return F.when(correct, 1.0).otherwise(-1.0) - factor * F.greatest(F.lit(0), length - soft) / F.lit(float(most - soft))


def group_relative(value: Column, group: str) -> Column:
    """(value - mean) / standard deviation within a group; an extra beside the settings-only original."""
    w = Window.partitionBy(group)
    return F.try_divide(value - F.avg(value).over(w), F.stddev_samp(value).over(w))


def expected_counts(rows: DataFrame, key: str, expected: dict[str, int]) -> DataFrame:
    """Counts per key beside the expected ones; unexpected and missing keys show with null or zero."""
    want = rows.sparkSession.createDataFrame(sorted(expected.items()), f"{key} string, expected long")
    have = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return want.join(have, key, "full_outer").select(key, "expected", F.coalesce("n", F.lit(0)).alias("n"), (F.col("expected").eqNullSafe(F.coalesce("n", F.lit(0)))).alias("ok"))

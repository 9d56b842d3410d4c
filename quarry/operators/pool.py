"""Pool rows, regrades, references and exports around graded answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.grading import annotation_of, equivalent_of, graded_of, parseable_of, reference_issue_of
from quarry.functions.spans import last_boxed_of
from quarry.functions.text import choice_answer, declared_answer, split_reasoning


def gold_gate(rows: DataFrame, gold: str) -> DataFrame:
    """rows with parseable. The parser sees each distinct answer once."""
    told = rows.select(gold).distinct().select(F.col(gold).alias("_gold"), parseable_of(F.col(gold)).alias("parseable"))
    return rows.join(told, F.col(gold).eqNullSafe(F.col("_gold"))).drop("_gold")


def equivalences(rows: DataFrame, a: str, b: str) -> DataFrame:
    """rows with same: both answers are gold answers and equal. Each distinct pair is compared once."""
    told = rows.select(a, b).distinct().select(F.col(a).alias("_a"), F.col(b).alias("_b"), equivalent_of(F.col(a), F.col(b)).alias("same"))
    return rows.join(told, F.col(a).eqNullSafe(F.col("_a")) & F.col(b).eqNullSafe(F.col("_b"))).drop("_a", "_b")


def reference_issues(rows: DataFrame, gold: str, problem: str) -> DataFrame:
    """rows with issue: why the gold answer cannot serve as a reference, or null."""
    told = rows.select(gold, problem).distinct().select(F.col(gold).alias("_g"), F.col(problem).alias("_p"), reference_issue_of(F.col(gold), F.col(problem)).alias("issue"))
    return rows.join(told, F.col(gold).eqNullSafe(F.col("_g")) & F.col(problem).eqNullSafe(F.col("_p"))).drop("_g", "_p")


def sourced_answer(source: Column, answer: Column, solution: Column, metadata: Column) -> Column:
    """(gold_answer, answer_origin) of a pool row by its source: the last box of the solution; or the answer in the metadata
    (its doubled backslashes undone), else the box, else the solution itself; or the answer as it is."""
    boxed = last_boxed_of(F.coalesce(solution, F.lit("")))
    listed = F.try_element_at(F.map_values(F.map_filter(metadata, lambda k, _: F.lower(k) == "answer")), F.lit(1))
    pair = lambda value, origin: F.struct(F.trim(value).alias("gold_answer"), F.lit(origin).alias("answer_origin"))
    from_metadata = pair(F.replace(listed, F.lit("\\\\"), F.lit("\\")), "metadata:answer")
    s1 = F.when(listed.isNotNull(), from_metadata).when(boxed.isNotNull(), pair(boxed, "solution:last_boxed")).otherwise(pair(F.coalesce(solution, F.lit("")), "solution:direct"))
    return F.when(source == "math", pair(boxed, "solution:last_boxed")).when(source == "s1", s1).otherwise(pair(answer, "answer"))


def selected_pool(rows: DataFrame, near_misses: DataFrame, key: str, types: list[str], sub_sources: list[str], flags: list[str]) -> DataFrame:
    """Pool rows that are no near miss, of a listed question type, from no listed sub-source, and with no false flag (null
    flags say nothing)."""
    wanted = F.col("question_type").isin(types) & ~F.coalesce(F.col("sub_source").isin(sub_sources), F.lit(False))
    for flag in flags:
        wanted = wanted & F.coalesce(F.col(flag), F.lit(True))
    return rows.filter(wanted).join(near_misses.select(key).distinct(), key, "left_anti")


def annotated(rows: DataFrame) -> DataFrame:
    """Grades of the eight responses of each row: rows (responses, finish, tokens, gold, problem, kind) with extracted,
    correct, methods, errors, num_correct."""
    found = annotation_of("responses", "finish", "tokens", "gold", "problem", "kind")
    return rows.withColumn("_a", found).select(*rows.columns, "_a.*")


def regraded(rows: DataFrame) -> DataFrame:
    """rows (response, gold, problem, answer_type, extracted, correct, method): those of type other are graded anew, which
    changes extracted, correct and method and nothing else."""
    other = F.col("answer_type") == "other"
    again = graded_of(F.when(other, F.col("response")), "gold", "problem", "answer_type")
    new = {c: F.when(other, F.col(f"_g.{n}")).otherwise(F.col(c)) for c, n in (("extracted", "answer"), ("correct", "correct"), ("method", "method"))}
    return rows.withColumn("_g", again).withColumns(new).drop("_g")


def scores(rows: DataFrame) -> DataFrame:
    """rows (benchmark, response, choices, target) with prediction, correct, unparsed: an option letter where there are
    choices, else the declared answer; an instruction benchmark is scored elsewhere and has nulls."""
    prediction = F.when(F.col("choices").isNotNull(), choice_answer(F.col("response"), F.col("choices"))).otherwise(declared_answer(F.col("response"), F.col("target")))
    own = rows.withColumn("prediction", F.when(F.col("benchmark") != "ifeval", prediction))
    scored = F.col("benchmark") != "ifeval"
    return own.withColumns({"correct": F.when(scored, F.coalesce(F.col("prediction") == F.col("target"), F.lit(False))), "unparsed": F.when(scored, F.col("prediction").isNull())})


def exported_answers(questions: DataFrame, responses: DataFrame, key: list[str]) -> DataFrame:
    """Responses with their question and gold answer, reasoning split off, and truncated, in the order of the key as text."""
    split = responses.withColumn("_s", split_reasoning(F.col("response")))
    joined = split.join(questions.withColumnRenamed("answer", "gold_answer"), key)
    told = joined.withColumn("truncated", F.col("finish_reason") == "length")
    return told.select(*key, "problem", "gold_answer", F.col("_s.reasoning").alias("reasoning"), F.col("_s.answer").alias("answer"), F.col("_s.status").alias("status"), "truncated").orderBy(*[F.col(k).cast("string") for k in key])


def cached_mismatches(series: DataFrame, run: str, step: str, cached: str, *values: str) -> DataFrame:
    """Steps that are marked as cached and whose values differ from those of the step before, or that have none before."""
    before = Window.partitionBy(run).orderBy(step)
    told = series.withColumn("_now", F.struct(*values)).withColumn("_before", F.lag("_now").over(before))
    return told.filter(F.col(cached) & ~F.col("_now").eqNullSafe(F.col("_before"))).select(run, step)


def map_means(rows: DataFrame, by: list[str], values: str) -> DataFrame:
    """Mean of each entry of a map column by group: by, name, mean, n."""
    return rows.select(*by, F.explode(values).alias("name", "_v")).groupBy(*by, "name").agg(F.avg("_v").alias("mean"), F.count("_v").alias("n"))


def preview(text: Column, start: Column, mask: str = "_") -> Column:
    """A training text with everything before the loss region masked, character by character, line feeds kept."""
    return F.concat(F.regexp_replace(F.substr(text, F.lit(1), start), r"[^\n]", mask), F.substr(text, start + 1))


def protocol_differences(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Groups in which a field of the protocol takes several values (null is a value), with those fields."""
    counts = [F.count_distinct(F.struct(F.col(f))).alias(f"_{i}") for i, f in enumerate(fields)]
    many = F.array_compact(F.array(*[F.when(F.col(f"_{i}") > 1, f) for i, f in enumerate(fields)]))
    return rows.groupBy(key).agg(*counts).select(key, many.alias("fields")).filter(F.size("fields") > 0)


def batch_schedule(rows: int, batch: int, epochs: int) -> dict[str, int]:
    """Steps of a training run: per epoch, in all, and rows of the last batch of an epoch."""
    if min(rows, batch, epochs) < 1:
        raise ValueError("rows, batch and epochs must be positive")
    per_epoch = -(-rows // batch)
    return {"steps_per_epoch": per_epoch, "steps": per_epoch * epochs, "last_batch": rows - batch * (per_epoch - 1)}

"""Envelopes, pool rows, annotations, merges and training examples.

Joins are equi joins whose strategy the optimizer chooses; checks that would stop a run are raise_error expressions or the
violation tables of operators.checks. Null means "not evaluated" and is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.literals import literal_map_of
from quarry.functions.text import has_chat_token

ANNOTATION = ("responses", "extracted", "correct", "tokens", "finish", "num_correct")


def envelope(rows: DataFrame, name: str, split: str, problem: str, answer: str, identifier: str | None, order: str) -> DataFrame:
    """id, problem, answer and the original row as JSON; without an id column, ids are name:split:place by order (dense per
    range partition of the order, so no task numbers all rows)."""
    original = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"})
    place = F.col(order).cast("string")
    made = F.col(identifier).cast("string") if identifier else F.concat(F.lit(f"{name}:{split}:"), place)
    return rows.select(made.alias("id"), F.col(problem).alias("problem"), F.col(answer).cast("string").alias("answer"), original.alias("original"))


def unwrapped(prompt: Column, prefix: str) -> Column:
    """The problem inside a prompt that starts with a known prefix; another start is an error, null stays null."""
    return F.when(prompt.startswith(prefix), F.trim(F.substr(prompt, F.lit(len(prefix) + 1)))).when(
        prompt.isNotNull(), F.raise_error(F.concat(F.lit("unknown prompt wrapper: "), F.substring(prompt, 1, 40))).cast("string")
    )


def pool_rows(rows: DataFrame, source: str, priority: int, repo: str, revision: str, config: str, split: str, index: str, problem: str, gold: str, sub_source: Column, metadata: Column) -> DataFrame:
    """The fixed record of the pool: a SHA-256 id over its lineage, problem, trimmed gold, and metadata as a map."""
    lineage = F.concat(F.lit(f"{repo}@{revision}:{config}:{split}:"), F.col(index).cast("string"))
    return rows.select(
        F.sha2(lineage, 256).alias("id"), F.lit(source).alias("dataset_source"), F.lit(priority).alias("priority"), F.lit(repo).alias("source_repo"),
        F.lit(revision).alias("source_revision"), F.lit(config).alias("source_config"), F.lit(split).alias("source_split"), F.col(index).cast("long").alias("source_index"),
        sub_source.alias("sub_source"), F.coalesce(F.col(problem), F.lit("")).alias("problem"), F.trim(F.col(gold).cast("string")).alias("gold_answer"), metadata.alias("metadata"),
    )


#: Metadata keys that are kept.
METADATA = ("source", "domain", "subject", "type", "level", "difficulty", "field", "subfield", "answer_type", "question_type", "problem_type", "id", "year", "problem number", "part", "category", "theorem", "theorem category")


def allowed_metadata(metadata: Column) -> Column:
    return F.map_filter(metadata, lambda k, _: F.lower(k).isin(*METADATA))


def literal_metadata(rows: DataFrame, column: str) -> DataFrame:
    """rows with a column of dict literals as a map of the entries that are kept (empty for anything else, null too). Each
    distinct literal is parsed once."""
    told = rows.select(F.col(column).alias("_text")).distinct().withColumn("_map", allowed_metadata(literal_map_of("_text")))
    return rows.join(told, F.col(column).eqNullSafe(F.col("_text"))).withColumn(column, F.col("_map")).drop("_text", "_map")


def source_fields(columns: list[str], problem: str = "problem", original: str = "original") -> Column:
    """A struct of the fields of an envelope that a source has processed: the problem from the envelope itself, the others
    from the original row. A field that the source lacks is an analysis error."""
    return F.struct(*[F.col(problem).alias(c) if c == "problem" else F.col(f"{original}.`{c}`").alias(c) for c in columns])


def merged_annotations(rows: DataFrame, journal: DataFrame, index: str, prefix: str) -> DataFrame:
    """All rows with the journal's annotation columns under a prefix, null where the journal has none."""
    own = journal.select(F.col(index), *[F.col(c).alias(prefix + c) for c in ANNOTATION if c in journal.columns])
    return rows.join(own, index, "left")


def aligned(a: DataFrame, b: DataFrame, index: str, columns: tuple[str, ...]) -> DataFrame:
    """Rows of two tables joined on their place, with ok: both are there and the listed columns are equal."""
    left, right = a.select(index, F.struct(*columns).alias("_a")), b.select(index, F.struct(*columns).alias("_b"))
    return left.join(right, index, "full_outer").select(index, (F.col("_a").isNotNull() & F.col("_b").isNotNull() & F.col("_a").eqNullSafe(F.col("_b"))).alias("ok"))


def completeness(documents: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """Keys that only documents or only responses have, with the side that lacks them."""
    left, right = documents.select(key, F.lit(1).alias("_d")).distinct(), responses.select(key, F.lit(1).alias("_r")).distinct()
    return left.join(right, key, "full_outer").filter("_d IS NULL OR _r IS NULL").select(key, F.when(F.col("_d").isNull(), "document").otherwise("response").alias("lacking"))


def pending(selected: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Selected rows that are not done."""
    return selected.join(done.select(key).distinct(), key, "left_anti")


def few_shot(questions: DataFrame, demos: DataFrame, subject: str, order: str, text: Column, most: int | None = None) -> DataFrame:
    """Questions with the demonstrations of their subject, in order, joined to one prefix."""
    shown = demos.groupBy(subject).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))).alias("d"))
    picked = F.col("d") if most is None else F.slice("d", 1, most)
    return questions.join(shown.select(subject, F.array_join(F.transform(picked, lambda x: x["t"]), "").alias("prefix")), subject, "left")


def choice_prompt(question: Column, options: Column) -> Column:
    """A question with lettered options; placeholders without content go."""
    lettered = F.transform(F.filter(options, lambda o: o != "N/A"), lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o, F.lit("\n")))
    return F.concat(F.lit("Question:\n"), question, F.lit("\nOptions:\n"), F.array_join(lettered, ""), F.lit("Answer: Let's think step by step."))


def chat(system: Column, user: Column) -> Column:
    """A rendered two-message prompt; texts that hold a token of the format are an error."""
    bad = has_chat_token(system) | has_chat_token(user)
    whole = F.concat(F.lit("<|im_start|>system\n"), system, F.lit("<|im_end|>\n<|im_start|>user\n"), user, F.lit("<|im_end|>\n<|im_start|>assistant\n"))
    return F.when(bad, F.raise_error(F.lit("a message holds a chat token")).cast("string")).otherwise(whole)


def labels(prompt_tokens: Column, response_tokens: Column, ignored: int = -100) -> Column:
    """Training labels: the prompt is masked, the response kept."""
    return F.concat(F.transform(prompt_tokens, lambda _: F.lit(ignored).cast("long")), response_tokens)


def padded(values: Column, width: Column, fill: int) -> Column:
    """An array at the width of its batch."""
    return F.concat(values, F.array_repeat(F.lit(fill).cast("long"), F.greatest(width - F.size(values), F.lit(0))))


def collated(rows: DataFrame, position: str, size: int, values: str, fill: int) -> DataFrame:
    """Rows in batches of consecutive positions, each array at its batch's width."""
    batch = F.floor(F.col(position) / size)
    width = F.max(F.size(values)).over(Window.partitionBy("batch"))
    return rows.withColumn("batch", batch).withColumn(values, padded(F.col(values), width, fill))


def trainable(rows: DataFrame, length: Column, most: int) -> DataFrame:
    """Rows with drop: why a row is no training example (missing_output, overlength), or null."""
    output = F.trim(F.coalesce(F.col("response"), F.lit("")))
    return rows.withColumn("drop", F.when(output == "", "missing_output").when(length > most, "overlength"))


def integer_gold(rows: DataFrame, gold: str, length: Column, most: int) -> DataFrame:
    """RL rows with an integer gold answer (another is an error) and a prompt within the limit."""
    checked = F.when(F.col(gold).rlike(r"^[+-]?[0-9]+$"), F.col(gold)).otherwise(F.raise_error(F.concat(F.lit("not an integer: "), F.coalesce(F.col(gold), F.lit("null")))))
    return rows.withColumn(gold, checked).filter(length <= most)


def trimmed(rows: DataFrame, column: str) -> DataFrame:
    """rows with trailing white space gone from a column, and whether it changed."""
    new = F.regexp_replace(F.col(column), r"\s+$", "")
    return rows.withColumn("changed", F.coalesce(F.col(column) != new, F.lit(False))).withColumn(column, new)


def completion_budget(prompt: Column, context: int, cap: int) -> Column:
    """Tokens left for a completion, the cap for a null prompt. None left (zero or less) is a finding about that row and no
    reason to lose the others; has_room() makes it an error where a completion is about to be asked for."""
    return F.least(F.lit(cap), context - prompt)


def has_room(budget: Column) -> Column:
    """The budget, where there is one; none left is an error."""
    return F.when(budget > 0, budget).otherwise(F.raise_error(F.lit("no room for a completion")).cast("int"))

"""Rule filters: every filter tags rows with all reasons that apply, in a fixed order; the first is the primary one.

Kept and removed rows are views of one tagged table, so nothing is lost between them. Rules are regexes and comparisons on
columns; a costly check (parsing a reference answer) runs only on rows that no rule has removed.

Null texts count as empty. Repeated rows are tagged alike; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import normal_lexical

#: Text exclusion rules by category, in their order.
EXCLUSIONS = {
    "translation_instruction": r"(?i)\btranslat(?:e|ing)\s+(?:the\s+)?(?:above\s+text|text\s+above|following\s+text)\b"
    r"|\b(?:output|provide)\s+the\s+translation\s+result\b"
    r"|\bplease\s+(?:retain|keep|preserve)\s+(?:the\s+)?original\s+text"
    r"|\b(?:keep|retain|preserve)\b[^\n]{0,100}\bline\s*breaks\b[^\n]{0,100}\btranslat(?:ion|ed)\b",
    "chinese_characters": r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{2ee5f}\x{2f800}-\x{2fa1f}\x{30000}-\x{323af}]",
    "visual_reference": r"(?i)\[(?:img|asy)\]|!\[[^\]]*\]\(|<img\b|\\includegraphics\b|\\begin\{tikzpicture\}"
    r"|https?://\S+\.(?:png|jpg|jpeg|svg|gif|webp)\b"
    r"|\b(?:as\s+(?:shown|illustrated|depicted)|shown\s+(?:below|above|opposite|here|on the right|on the left))\b"
    r"|\b(?:in|from|see|using|refer to|according to)\s+(?:(?:the|this|that|a|an|accompanying|following|given|attached)\s+)+(?:figure|diagram|picture|drawing|illustration|image)\b"
    r"|\b(?:this|following|accompanying|attached|above|below)\s+(?:figure|diagram|picture|drawing|illustration|image)\b"
    r"|\b(?:figure|diagram|picture|drawing|illustration|image)\s+(?:below|above|shows|illustrates|depicts|on the right|on the left)\b"
    r"|\b(?:figure|fig\.)\s*\d+\b"
    r"|\b(?:graph|graphs|pattern|patterns|arrangement|arrangements|shape|shapes|region|regions|sector|sectors)\b[^.?!\n]{0,90}\b(?:is|are)?\s*shown\b",
}


#: Signs of other domains, positive evidence of mathematics, and sources that are allowed.
OTHER_DOMAINS = r"physics|/phy\b|chem|biology|astronomy|science|puzzle|crossword|code|proof|bool"
MATH_EVIDENCE = "mathematics|algebra|geometry|number theory|calculus|combinatorics|probability|statistics"
MATH_SOURCES = ("aime", "numinamath", "omni-math", "openaimath", "/math", "stats_qual", "qfq/quant")

#: What makes a problem's answer hard to verify.
PROOF = r"(?i)\b(prove|show that|demonstrate|justify)\b"
OPTION = r"(?:^|[^\p{L}\p{N}_])[A-E][.)]"
PART = r"\([a-d]\)|(?m:^\s*[1-9][.)]\s)"
TASK = r"(?i)\b(?:find|calculate|determine|compute|evaluate)\b"
TWO_TASKS = r"(?i)\b(?:find|calculate|determine|compute)\b[^.?!\n]{0,100}\band\b"


def reasons(*rules: tuple[str, Column]) -> Column:
    """The names of the rules that hold, in order; a null condition does not hold."""
    return F.filter(F.array(*[F.when(condition, F.lit(name)) for name, condition in rules]), lambda r: r.isNotNull())


def tagged(rows: DataFrame, *rules: tuple[str, Column]) -> DataFrame:
    """rows with reasons (all) and reason (the first, null for kept rows)."""
    return rows.withColumn("reasons", reasons(*rules)).withColumn("reason", F.get("reasons", F.lit(0)))


def kept(rows: DataFrame) -> DataFrame:
    return rows.filter("reason IS NULL").drop("reasons", "reason")


def removed(rows: DataFrame) -> DataFrame:
    return rows.filter("reason IS NOT NULL")


def text_exclusions(text: Column, rules: dict[str, str] | None = None) -> Column:
    """An array of structs of reason, match, start (from 0) and excerpt (60 characters before to 120 after the match)."""
    out = []
    for name, pattern in (rules or EXCLUSIONS).items():
        at = F.regexp_instr(text, F.lit(pattern))
        match = F.regexp_substr(text, F.lit(pattern))
        begin = F.greatest(at - 61, F.lit(0))
        excerpt = F.substr(text, begin + 1, at - 1 - begin + F.length(match) + 120)
        out.append(F.when(match.isNotNull(), F.struct(F.lit(name).alias("reason"), match.alias("match"), (at - 1).cast("long").alias("start"), excerpt.alias("excerpt"))))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def with_exclusions(rows: DataFrame, text: str) -> DataFrame:
    """rows with evidence, reasons and reason."""
    told = rows.withColumn("evidence", text_exclusions(F.coalesce(F.col(text), F.lit(""))))
    return told.withColumn("reasons", F.transform("evidence", lambda x: x["reason"])).withColumn("reason", F.get("reasons", F.lit(0)))


def rule_counts(tagged_rows: DataFrame) -> DataFrame:
    """Rows for each rule."""
    return tagged_rows.select(F.explode("reasons").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def overlap_counts(tagged_rows: DataFrame) -> DataFrame:
    """Rows for each combination of rules."""
    return removed(tagged_rows).groupBy(F.array_join("reasons", " + ").alias("combination")).agg(F.count(F.lit(1)).alias("n"))


def rule_source_counts(tagged_rows: DataFrame, source: str) -> DataFrame:
    """Rows for each rule and source."""
    return tagged_rows.select(source, F.explode("reasons").alias("rule")).groupBy("rule", source).agg(F.count(F.lit(1)).alias("n"))


def funnel(tagged_rows: DataFrame, source: str) -> DataFrame:
    """Rows by source and primary reason (kept for none): sums to the input, whatever the rules."""
    return tagged_rows.groupBy(source, F.coalesce("reason", F.lit("kept")).alias("stage")).agg(F.count(F.lit(1)).alias("n"))


def many(text: Column, pattern: str, at_least: int) -> Column:
    """Whether a pattern occurs so often."""
    return F.regexp_count(text, F.lit(pattern)) >= at_least


def math_domain(cot_type: Column, source: Column, labels: Column) -> Column:
    """Whether a row of the mixed-domain source is mathematics: by type, without a sign of another domain, and from an
    allowed source (one source needs positive evidence in its labels)."""
    other = F.lower(F.concat_ws(" ", source, labels)).rlike(OTHER_DOMAINS)
    shown = F.lower(labels).rlike(MATH_EVIDENCE)
    allowed = F.exists(F.array(*map(F.lit, MATH_SOURCES)), lambda x: F.contains(F.lower(source), x))
    return (F.lower(cot_type) == "math") & ~other & F.when(F.contains(F.lower(source), F.lit("theoremqa")), shown).otherwise(allowed)


def verifiability_rules(problem: Column, gold: Column, labels: Column, source: Column, excluded: tuple[str, ...], valid: Column, domain: Column) -> list[tuple[str, Column]]:
    """Why a problem's answer could not be verified, in order. labels: its type labels in lower case; valid and domain:
    whether the dataset calls it valid and it is of the wanted domain (null counts as yes)."""
    text = F.coalesce(problem, F.lit(""))
    proof_label = F.contains(labels, F.lit("proof"))
    letters = F.regexp_count(text, F.lit(OPTION))
    parts = many(text, PART, 2) | many(text, TASK, 2) | text.rlike(TWO_TASKS) | many(text, r"\?", 2)
    return [
        ("nonmath_or_unconfirmed_domain", ~domain),
        ("excluded_sub_source", F.lower(source).isin(*excluded)),
        ("dataset_invalid", ~valid),
        ("proof_label", proof_label),
        ("proof_heuristic", ~proof_label & text.rlike(PROOF)),
        ("multiple_choice", labels.rlike("multiple.choice|choice") | (letters >= 2)),
        ("multipart_heuristic", labels.rlike("multi.part|multiple.answer") | parts),
        ("empty_problem", normal_lexical(text) == ""),
        ("missing_gold", F.coalesce(gold, F.lit("")) == ""),
    ]


def with_gold_gate(tagged_rows: DataFrame, parseable: Column) -> DataFrame:
    """The last reason: a gold answer that does not parse, looked at only where no rule has spoken."""
    bad = F.col("reason").isNull() & ~F.when(F.col("reason").isNull(), parseable)
    return tagged_rows.withColumn("reason", F.when(bad, F.lit("unparseable_or_nonscalar_gold")).otherwise(F.col("reason"))).withColumn(
        "reasons", F.when(F.col("reason") == "unparseable_or_nonscalar_gold", F.array(F.col("reason"))).otherwise(F.col("reasons"))
    )


#: Review heuristics, in their order.
REVIEW = (
    ("ambiguous_concatenated_powers", r"\d+\^\d+\d\^\d+", 1),
    ("image_reference", r"(?i)\[img\]|!\[[^\]]*\]\(|<img\b|https?://\S+\.(?:png|jpg|jpeg|svg|gif)", 1),
    ("diagram_requires_review", r"(?i)(?:as shown|shown below|following diagram|this figure|in the (?:figure|diagram))", 1),
    ("proof_requires_review", r"(?i)\b(?:prove|show that|demonstrate that)\b", 1),
    ("multipart_requires_review", r"\([a-d]\)|(?m:^\s*[1-9][.)]\s)|\((?:i|ii|iii)\)", 2),
    ("multiple_choice", r"\([A-E]\)|(?m:^\s*[A-E][.)]\s)", 2),
    ("multiple_required_values", r"(?i)(?:find|determine|calculate)\b[^.?!\n]{0,100}\b(?:maximum and minimum|minimum and maximum|both)\b", 1),
    ("multiple_questions_requires_review", r"\?", 2),
    ("malformed_or_solution_fragment", r"(?i)\band\s*\$0+\$|\b(?:solution|proof)\s*:", 1),
)


def review_rules(text: Column, quarantined: Column, reference_issue: Column | None = None) -> list[tuple[str, Column]]:
    """Pre-generation heuristics; quarantined: the row's source is under quarantine and the row is not reviewed."""
    rules = [(name, many(text, pattern, n)) for name, pattern, n in REVIEW]
    out = [("unreviewed_source_subset", quarantined), rules[0]]
    if reference_issue is not None:
        out.append(("reference_issue", reference_issue))
    return out + rules[1:]


def reviewed(rows: DataFrame, registry: DataFrame, quarantined_sources: tuple[str, ...]) -> DataFrame:
    """Rows after reviewed actions and heuristics. rows: id, text, gold, source. registry: id, digest, expected_gold, action
    (correct or quarantine), corrected_gold.

    A registry row whose digest or gold no longer fits its row is an error, never applied. Adds gold_original, action
    (unchanged, gold_corrected, quarantine), reasons and reason. The optimizer broadcasts the registry while it is small."""
    known = registry.select(F.col("id"), F.col("digest").alias("_digest"), F.col("expected_gold").alias("_gold"), F.col("action").alias("_action"), F.col("corrected_gold").alias("_new"))
    both = rows.join(known, "id", "left")
    stale = F.col("_action").isNotNull() & ~((F.sha2("text", 256) == F.col("_digest")) & (F.col("gold").eqNullSafe(F.col("_gold"))))
    action = F.when(stale, F.raise_error(F.concat(F.lit("reviewed source changed for "), F.col("id").cast("string")))).otherwise(F.col("_action"))
    both = both.withColumn("_action", action)
    quarantined = F.col("_action").isNull() & F.col("source").isin(*quarantined_sources)
    told = tagged(both, *review_rules(F.coalesce("text", F.lit("")), quarantined))
    manual = F.col("_action") == "quarantine"
    told = told.withColumn("reason", F.when(manual, F.lit("reviewed_quarantine")).otherwise(F.col("reason")))
    done = F.when(F.col("reason").isNotNull(), "quarantine").when(F.col("_action") == "correct", "gold_corrected").otherwise("unchanged")
    return told.select(*[c for c in rows.columns if c != "gold"], F.col("gold").alias("gold_original"), F.when(F.col("_action") == "correct", F.col("_new")).otherwise(F.col("gold")).alias("gold"), done.alias("action"), "reasons", "reason")


def trace_reasons(trace: Column, problem: Column, missing_finish: str = "verify") -> Column:
    """The first reason against a trace struct (text, correct, finish, complete), or null. A missing verdict is not true."""
    finish = trace["finish"]
    unproven = F.lit(True) if missing_finish == "drop" else ~F.coalesce(trace["complete"], F.lit(False))
    return (
        F.when(F.trim(F.coalesce(problem, F.lit(""))) == "", "invalid_problem")
        .when(~F.coalesce(trace["correct"], F.lit(False)), "incorrect_or_unverified")
        .when(F.trim(F.coalesce(trace["text"], F.lit(""))) == "", "empty_generation")
        .when(finish == "length", "truncated")
        .when(finish.isNotNull() & (finish != "stop"), "other_finish_reason")
        .when(trace["complete"] == False, "incomplete_reasoning")  # noqa: E712
        .when(finish.isNull() & unproven, "missing_completion_evidence")
    )


def traces(rows: DataFrame, most: int, tokens, missing_finish: str = "verify") -> DataFrame:
    """One row per trace with its place and first reason (overlength last: more than most tokens of problem and trace).

    rows: id, source, problem, generations, correct, finish, complete (parallel arrays; the last two may be null). Arrays
    of different sizes are an error. tokens: a function from a text column to a count."""
    size = F.size("generations")
    whole = lambda c: F.coalesce(F.col(c), F.array_repeat(F.lit(None), size))
    aligned = F.when(F.col("finish").isNull() | (F.size("finish") == size), F.when(F.col("complete").isNull() | (F.size("complete") == size), F.size("correct") == size))
    checked = rows.withColumn("generations", F.when(F.coalesce(aligned, F.lit(False)), F.col("generations")).otherwise(F.raise_error(F.lit("misaligned trace arrays"))))
    zipped = F.arrays_zip(F.col("generations").alias("text"), "correct", whole("finish").alias("finish"), whole("complete").alias("complete"))
    each = checked.select("id", "source", "problem", F.posexplode(zipped).alias("place", "trace"))
    told = each.withColumn("first", trace_reasons(F.col("trace"), F.col("problem"), missing_finish)).withColumn("length", tokens(F.col("problem")) + tokens(F.col("trace.text")))
    return told.select("id", "source", "problem", "place", "trace", "length", F.when(F.col("first").isNotNull(), F.col("first")).when(F.col("length") > most, "overlength").alias("reason"))


def kept_traces(told: DataFrame) -> DataFrame:
    """Per problem with kept traces: their texts, places and lengths, in order."""
    own = told.filter("reason IS NULL").groupBy("id", "source").agg(F.sort_array(F.collect_list(F.struct("place", F.col("trace.text").alias("text"), "length"))).alias("t"))
    return own.select("id", "source", F.transform("t", lambda x: x["text"]).alias("generations"), F.transform("t", lambda x: x["place"]).alias("places"), F.transform("t", lambda x: x["length"]).alias("lengths"))


def trace_counts(told: DataFrame) -> DataFrame:
    """Traces by source and reason and over all sources, in one pass over grouping sets."""
    rolled = told.groupingSets([["source", "reason"], ["reason"]], "source", "reason").agg(F.grouping("source").alias("_all"), F.count(F.lit(1)).alias("n"))
    return rolled.select(F.when(F.col("_all") == 1, "all").otherwise(F.col("source")).alias("source"), F.coalesce("reason", F.lit("kept")).alias("reason"), "n")


def clean_responses(correct: Column, finish: Column, text: Column, least: int = 80) -> Column:
    """Correct, stopped, boxed, without Han characters, code fences or chat roles, and long enough."""
    return (
        F.coalesce(correct, F.lit(False)) & (finish == "stop") & F.contains(text, F.lit("\\boxed{")) & ~text.rlike(EXCLUSIONS["chinese_characters"])
        & ~text.rlike(r"```|(?m)^\s*(?:user|assistant|system)\s*:|<\|") & (F.length(text) >= least)
    )


def valid_annotation(size: int = 8) -> Column:
    """Whether the columns responses, extracted, correct, tokens, finish and num_correct make one annotation: all null (not
    evaluated), or arrays of the size with a matching count and sound elements."""
    arrays = ("responses", "extracted", "correct", "tokens", "finish")
    none = F.col("num_correct").isNull()
    for c in arrays:
        none = none & F.col(c).isNull()
    good = F.col("num_correct") == F.size(F.filter("correct", lambda x: x))
    for c in arrays:
        good = good & (F.size(c) == size)
    good = good & F.forall("tokens", lambda x: x >= 0) & F.forall("correct", lambda x: x.isNotNull()) & F.forall("finish", lambda x: x.isin("stop", "length"))
    return none | F.coalesce(good, F.lit(False))

"""Filter queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import filters
from quarry.plans.registry import query
from quarry.session import table


def q(text: str) -> str:
    return text.replace("'", "''")


RE2 = {name: q(pattern) for name, pattern in filters.EXCLUSIONS.items()}
#: All matches' first: RE2 has no position function, so the start is the length of what stands before the match.
EVIDENCE = "ev AS (" + " UNION ALL ".join(
    f"SELECT id, source, {i} AS o, '{name}' AS reason, regexp_extract(text, '{pattern}') AS match, length(split_part(text, regexp_extract(text, '{pattern}'), 1)) AS start FROM t WHERE regexp_matches(text, '{pattern}')"
    for i, (name, pattern) in enumerate(RE2.items())
) + ")"
TEXTS = """t AS (SELECT doc_id AS id, source, text FROM documents UNION ALL SELECT 1000000000 + page_id, 'page', html FROM pages UNION ALL SELECT 2000000000 + item_id, 'bench', CASE item_id % 5 WHEN 0 THEN 'As shown below: ' WHEN 1 THEN 'Please keep the original text. See Figure 12. ' WHEN 2 THEN '中文 ' ELSE '' END || text FROM benchmark)"""


def texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    pages = table(spark, sf_dir, "pages").select((1000000000 + F.col("page_id")).alias("id"), F.lit("page").alias("source"), F.col("html").alias("text"))
    kind = F.col("item_id") % 5
    head = F.when(kind == 0, "As shown below: ").when(kind == 1, "Please keep the original text. See Figure 12. ").when(kind == 2, "中文 ").otherwise("")
    bench = table(spark, sf_dir, "benchmark").select((2000000000 + F.col("item_id")).alias("id"), F.lit("bench").alias("source"), F.concat(head, "text").alias("text"))
    return docs.unionByName(pages).unionByName(bench)


@query("text_exclusions", f"WITH {TEXTS}, {EVIDENCE} SELECT ev.id, ev.reason, match, start, substr(text, greatest(start - 60, 0) + 1, start - greatest(start - 60, 0) + length(match) + 120) AS excerpt FROM ev JOIN t ON t.id = ev.id")
def text_exclusions(spark, sf_dir):
    return filters.with_exclusions(texts(spark, sf_dir), "text").select("id", F.explode("evidence").alias("e")).select("id", "e.*")


@query("exclusion_counts", f"WITH {TEXTS}, {EVIDENCE} SELECT 'rule' AS kind, reason AS name, source, count(*) AS n FROM ev GROUP BY ALL UNION ALL SELECT 'combination', names, NULL, count(*) FROM (SELECT string_agg(reason, ' + ' ORDER BY o) AS names FROM ev GROUP BY id) GROUP BY names")
def exclusion_counts(spark, sf_dir):
    told = filters.with_exclusions(texts(spark, sf_dir), "text")
    rules = filters.rule_source_counts(told, "source").select(F.lit("rule").alias("kind"), F.col("rule").alias("name"), "source", "n")
    return rules.unionByName(filters.overlap_counts(told).select(F.lit("combination").alias("kind"), F.col("combination").alias("name"), F.lit(None).cast("string").alias("source"), "n"))


PROBLEMS = """p AS (SELECT doc_id AS id, source, CASE doc_id % 6 WHEN 0 THEN 'Prove that ' WHEN 1 THEN '(a) Find x. (b) Compute y. ' WHEN 2 THEN 'Pick one: (A) x (B) y ' ELSE '' END || text AS text,
    CASE doc_id % 7 WHEN 0 THEN NULL ELSE (doc_id % 100)::VARCHAR END AS gold, CASE doc_id % 11 WHEN 0 THEN 'proof' WHEN 1 THEN 'multiple-choice' ELSE 'word' END AS labels FROM documents)"""


def problems(spark, sf_dir):
    d = F.col("doc_id")
    head = F.when(d % 6 == 0, "Prove that ").when(d % 6 == 1, "(a) Find x. (b) Compute y. ").when(d % 6 == 2, "Pick one: (A) x (B) y ").otherwise("")
    return table(spark, sf_dir, "documents").select(
        d.alias("id"), "source", F.concat(head, "text").alias("text"),
        F.when(d % 7 != 0, (d % 100).cast("string")).alias("gold"),
        F.when(d % 11 == 0, "proof").when(d % 11 == 1, "multiple-choice").otherwise("word").alias("labels"),
    )


def counted(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{q(pattern)}'))"


VERIFIABLE = f"""{PROBLEMS}, r AS (SELECT id, source, list_filter([
    CASE WHEN lower(source) IN ('src3', 'src7') THEN 'excluded_sub_source' END,
    CASE WHEN id % 13 = 0 THEN 'dataset_invalid' END,
    CASE WHEN contains(labels, 'proof') THEN 'proof_label' END,
    CASE WHEN NOT contains(labels, 'proof') AND regexp_matches(text, '(?i)\\b(prove|show that|demonstrate|justify)\\b') THEN 'proof_heuristic' END,
    CASE WHEN regexp_matches(labels, 'multiple.choice|choice') OR {counted(r'(?:^|[^\p{L}\p{N}_])[A-E][.)]')} >= 2 THEN 'multiple_choice' END,
    CASE WHEN {counted(r'\([a-d]\)|(?m:^\s*[1-9][.)]\s)')} >= 2 OR {counted(r'(?i)\b(?:find|calculate|determine|compute|evaluate)\b')} >= 2
        OR regexp_matches(text, '(?i)\\b(?:find|calculate|determine|compute)\\b[^.?!\\n]{{0,100}}\\band\\b') OR {counted(r'\?')} >= 2 THEN 'multipart_heuristic' END,
    CASE WHEN NOT regexp_matches(text, '[\\p{{L}}\\p{{N}}]') THEN 'empty_problem' END,
    CASE WHEN coalesce(gold, '') = '' THEN 'missing_gold' END], lambda x: x IS NOT NULL) AS reasons FROM p)"""


def verifiable(spark, sf_dir):
    own = problems(spark, sf_dir)
    rules = filters.verifiability_rules(F.col("text"), F.col("gold"), F.col("labels"), F.col("source"), ("src3", "src7"), F.col("id") % 13 != 0, F.lit(True))
    return filters.tagged(own, *rules)


@query("verifiability_reasons", f"WITH {VERIFIABLE} SELECT id, array_to_string(reasons, ',') AS reasons, coalesce(reasons[1], 'kept') AS reason FROM r")
def verifiability_reasons(spark, sf_dir):
    return verifiable(spark, sf_dir).select("id", F.array_join("reasons", ",").alias("reasons"), F.coalesce("reason", F.lit("kept")).alias("reason"))


@query("stage_funnel", f"WITH {VERIFIABLE} SELECT source, coalesce(reasons[1], 'kept') AS stage, count(*) AS n FROM r GROUP BY ALL")
def stage_funnel(spark, sf_dir):
    return filters.funnel(verifiable(spark, sf_dir), "source")


REVIEWED = f"""{PROBLEMS}, b AS (SELECT p.*, CASE WHEN l.toxic = 1 THEN 'quarantine' WHEN l.quality = 0 THEN 'correct' END AS act FROM p LEFT JOIN labels l ON l.doc_id = p.id),
    r AS (SELECT *, list_filter([CASE WHEN act IS NULL AND source IN ('src4', 'src5') THEN 'unreviewed_source_subset' END, {", ".join(f"CASE WHEN {counted(pattern)} >= {n} THEN '{name}' END" for name, pattern, n in filters.REVIEW)}], lambda x: x IS NOT NULL) AS reasons FROM b),
    done AS (SELECT id, source, CASE WHEN act = 'quarantine' THEN 'reviewed_quarantine' ELSE reasons[1] END AS reason, act, gold FROM r)"""


def reviewed(spark, sf_dir):
    own = problems(spark, sf_dir).select("id", "source", "text", "gold")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic", "quality")
    registry = own.join(labels, "id").filter("toxic = 1 OR quality = 0").select(
        "id", F.sha2("text", 256).alias("digest"), F.col("gold").alias("expected_gold"), F.when(F.col("toxic") == 1, "quarantine").otherwise("correct").alias("action"), F.lit("0").alias("corrected_gold")
    )
    return filters.reviewed(own, registry, ("src4", "src5"))


@query("quality_review", f"WITH {REVIEWED} SELECT id, coalesce(reason, 'none') AS reason, CASE WHEN reason IS NOT NULL THEN 'quarantine' WHEN act = 'correct' THEN 'gold_corrected' ELSE 'unchanged' END AS action, CASE WHEN act = 'correct' THEN '0' ELSE gold END AS gold FROM done")
def quality_review(spark, sf_dir):
    return reviewed(spark, sf_dir).select("id", F.coalesce("reason", F.lit("none")).alias("reason"), "action", "gold")


@query("quality_review_counts", f"WITH {REVIEWED} SELECT source, reason, count(*) AS n FROM done WHERE reason IS NOT NULL GROUP BY ALL")
def quality_review_counts(spark, sf_dir):
    return reviewed(spark, sf_dir).filter("reason IS NOT NULL").groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"))


TRACES = """e AS (SELECT l_orderkey AS id, l_linenumber AS place, l_returnflag AS source, 'p ' || l_orderkey::VARCHAR AS problem, CASE WHEN l_tax = 0 THEN ' ' ELSE repeat('w ', CAST(l_quantity AS BIGINT)) END AS text, CASE WHEN l_discount > 0.09 THEN NULL ELSE l_discount > 0.015 END AS correct,
    CASE WHEN l_quantity > 45 THEN 'length' WHEN l_quantity > 42 THEN 'abort' WHEN l_quantity > 20 THEN 'stop' END AS finish, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_linenumber <> 2 END AS complete FROM lineitem),
    r AS (SELECT *, CASE WHEN NOT coalesce(correct, false) THEN 'incorrect_or_unverified' WHEN trim(text) = '' THEN 'empty_generation' WHEN finish = 'length' THEN 'truncated' WHEN finish <> 'stop' THEN 'other_finish_reason'
    WHEN complete = false THEN 'incomplete_reasoning' WHEN finish IS NULL AND NOT coalesce(complete, false) THEN 'missing_completion_evidence' WHEN 2 + len(string_split(trim(text), ' ')) > 40 THEN 'overlength' END AS reason FROM e)"""


def traces(spark, sf_dir):
    n, tax = F.col("l_quantity"), F.col("l_tax")
    item = F.struct(
        F.col("l_linenumber").alias("n"), F.when(tax == 0, " ").otherwise(F.expr("repeat('w ', CAST(l_quantity AS INT))")).alias("text"),
        F.when(F.col("l_discount") > 0.09, None).otherwise(F.col("l_discount") > 0.015).alias("correct"),
        F.when(n > 45, "length").when(n > 42, "abort").when(n > 20, "stop").alias("finish"),
        F.when(F.col("l_linenumber") == 3, None).otherwise(F.col("l_linenumber") != 2).alias("complete"),
    )
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("source")).agg(F.sort_array(F.collect_list(item)).alias("t"))
    arrays = own.select("id", "source", F.concat(F.lit("p "), F.col("id").cast("string")).alias("problem"), F.transform("t", lambda x: x["text"]).alias("generations"), *[F.col("t")[c].alias(c) for c in ("correct", "finish", "complete")])
    tokens = lambda c: F.size(F.split(F.trim(c), " "))
    return filters.traces(arrays, 40, tokens)


@query("trace_counts", f"WITH {TRACES} SELECT coalesce(source, 'all') AS source, coalesce(reason, 'kept') AS reason, n FROM (SELECT source, reason, count(*) AS n FROM r GROUP BY GROUPING SETS ((source, reason), (reason)))")
def trace_counts(spark, sf_dir):
    return filters.trace_counts(traces(spark, sf_dir))


@query("kept_traces", f"WITH {TRACES} SELECT id, source, count(*) AS kept, sum(2 + len(string_split(trim(text), ' ')))::BIGINT AS tokens FROM r WHERE reason IS NULL GROUP BY ALL")
def kept_traces(spark, sf_dir):
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    return filters.kept_traces(traces(spark, sf_dir)).select("id", "source", F.size("generations").cast("long").alias("kept"), total.alias("tokens"))


@query("clean_responses", """SELECT conv_id, turn FROM (SELECT conv_id, turn, text || CASE turn % 2 WHEN 0 THEN ' \\boxed{4}' ELSE '' END AS text FROM conversations WHERE role <> 'system')
    WHERE contains(text, '\\boxed{') AND length(text) >= 80 AND NOT regexp_matches(text, '```|(?m)^\\s*(?:user|assistant|system)\\s*:|<\\|')""")  # fmt: skip
def clean_responses(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").filter("role <> 'system'")
    own = own.withColumn("text", F.concat("text", F.when(F.col("turn") % 2 == 0, " \\boxed{4}").otherwise("")))
    return own.filter(filters.clean_responses(F.lit(True), F.lit("stop"), F.col("text"))).select("conv_id", "turn")


@query("valid_annotations", """SELECT l_orderkey AS id, count(*) = 8 AND bool_and(l_tax >= 0) AND count(*) FILTER (l_discount > 0.045) = count(*) FILTER (l_discount > 0.045 AND l_linenumber < 8) AS valid FROM lineitem GROUP BY 1""")
def valid_annotations(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.collect_list(F.lit("r")).alias("responses"), F.collect_list(F.lit("x")).alias("extracted"), F.collect_list(F.col("l_discount") > 0.045).alias("correct"),
        F.collect_list(F.col("l_quantity").cast("long")).alias("tokens"), F.collect_list(F.lit("stop")).alias("finish"),
        F.count_if((F.col("l_discount") > 0.045) & (F.col("l_linenumber") < 8)).alias("num_correct"),
    )
    return own.select("id", filters.valid_annotation().alias("valid"))

"""Queries on answers: gold gate, equivalence, references, annotations, regrades, scores, and what surrounds them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import spans
from quarry.functions import text as T
from quarry.operators import checks, examples, metrics, pool
from quarry.plans.registry import query
from quarry.session import table


def _forms(k, column):
    """A gold answer of one of nine forms for a number column."""
    n = column.cast("string")
    forms = [F.concat(F.lit("\\sqrt{"), n, F.lit("}")), F.concat(n, F.lit("\\pi")), F.concat(n, F.lit("x+y")), F.concat(F.lit("x="), n), F.concat(n, F.lit(" apples")), F.lit("B"), F.concat(n, F.lit(",2")), F.concat(F.lit("\\frac{"), n, F.lit("}{0}")), F.lit("((")]
    out = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        out = F.when(k == i, form).otherwise(out)
    return out


@query("gold_gate", "SELECT l_orderkey, l_linenumber, l_suppkey % 10 < 4 AS parseable FROM lineitem")
def gold_gate(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _forms(F.col("l_suppkey") % 10, (F.col("l_partkey") % 50).cast("long")).alias("gold"))
    return pool.gold_gate(own, "gold").select("l_orderkey", "l_linenumber", "parseable")


@query(
    "equivalence",
    """SELECT l_orderkey, l_linenumber, CASE l_suppkey % 7 WHEN 0 THEN n * n * 2 = m * m * 2 WHEN 1 THEN n = m WHEN 2 THEN n = m WHEN 3 THEN n = m WHEN 4 THEN n = 2 * m WHEN 5 THEN n = m ELSE false END AS same
    FROM (SELECT *, 1 + l_partkey % 5 AS n, 1 + l_linenumber % 3 AS m FROM lineitem)""",
)
def equivalence(spark, sf_dir):
    n, m = ((1 + F.col(c) % k).cast("string") for c, k in (("l_partkey", 5), ("l_linenumber", 3)))
    k = F.col("l_suppkey") % 7
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    square = ((1 + F.col("l_partkey") % 5) * (1 + F.col("l_partkey") % 5) * 2).cast("string")
    pairs = [
        (text("\\sqrt{", square, "}"), text(m, "\\sqrt{2}")),
        (text(n, "\\pi"), text("\\pi \\cdot ", m)),
        (text("x+", n, "y"), text(m, "y+x")),
        (text("\\frac{", n, "}{\\sqrt{3}}"), text("\\frac{", m, "\\sqrt{3}}{3}")),
        (text("\\frac{", n, "}{2}"), text(m)),
        (text("2x>2\\cdot ", n), text(m, "<x")),
        (text(n, " words"), text(n, " words")),
    ]
    a = b = F.lit(None).cast("string")
    for i, (x, y) in enumerate(pairs):
        a, b = F.when(k == i, x).otherwise(a), F.when(k == i, y).otherwise(b)
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", a.alias("a"), b.alias("b"))
    return pool.equivalences(own, "a", "b").select("l_orderkey", "l_linenumber", "same")


@query("reference_issues", "SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'unparseable_reference' WHEN 2 THEN 'factorization_reference_requires_review' WHEN 3 THEN 'reference_check_failed' END AS issue FROM documents")
def reference_issues(spark, sf_dir):
    k = F.col("doc_id") % 5
    gold = F.when(k == 1, "((").when(k == 2, "x^2-1").when(k == 3, "3_2").when(k == 4, "(x-1)(x+1)").otherwise(F.col("doc_id").cast("string"))
    problem = F.when(k.isin(2, 4), "Factor completely").when(k == 3, "in base 2").otherwise("Compute")
    return pool.reference_issues(table(spark, sf_dir, "documents").select("doc_id", gold.alias("gold"), problem.alias("problem")), "gold", "problem").select("doc_id", "issue")


@query("annotations", "SELECT doc_id, (1 + doc_id % 8)::BIGINT AS num_correct, (1 + doc_id % 8)::BIGINT AS boxed FROM documents")
def annotations(spark, sf_dir):
    k = (1 + F.col("doc_id") % 8).cast("int")
    responses = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.when(i <= k, F.concat(F.lit("so \\boxed{\\frac{"), (2 * F.col("doc_id")).cast("string"), F.lit("}{2}}"))).otherwise("no idea about it"))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", responses.alias("responses"), F.array_repeat(F.lit("stop"), 8).alias("finish"), F.array_repeat(F.lit(5).cast("long"), 8).alias("tokens"),
        F.col("doc_id").cast("string").alias("gold"), F.lit("").alias("problem"), F.lit(None).cast("string").alias("kind"),
    )
    return pool.annotated(rows).select("doc_id", "num_correct", F.size(F.filter("methods", lambda x: x == "boxed")).cast("long").alias("boxed"))


@query("regraded_rows", "SELECT doc_id, doc_id % 3 = 0 AS correct, CASE WHEN doc_id % 3 = 0 THEN '7:30 pm' ELSE 'old' END AS extracted FROM documents")
def regraded_rows(spark, sf_dir):
    other = F.col("doc_id") % 3 == 0
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.lit("The answer is 7:30 pm.").alias("response"), F.lit("19:30").alias("gold"), F.lit("At what time?").alias("problem"), F.when(other, "other").otherwise("number").alias("answer_type"),
        F.lit("old").alias("extracted"), F.lit(False).alias("correct"), F.lit("missing").alias("method"),
    )
    return pool.regraded(rows).select("doc_id", "correct", "extracted")


@query("benchmark_scores", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'C' WHEN 1 THEN NULL WHEN 2 THEN lang END AS prediction, CASE doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN lang = 'en' END AS correct, CASE WHEN doc_id % 4 < 3 THEN doc_id % 4 = 1 END AS unparsed FROM documents")
def benchmark_scores(spark, sf_dir):
    k = F.col("doc_id") % 4
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(k == 3, "ifeval").otherwise("arc").alias("benchmark"), F.when(k == 0, "The answer is (C).").when(k == 1, "who knows").otherwise(F.concat(F.lit("The answer is "), "lang", F.lit("."))).alias("response"),
        F.when(k < 2, F.array(*map(F.lit, "ABCD"))).alias("choices"), F.when(k < 2, "C").otherwise("en").alias("target"),
    )
    return pool.scores(rows).select("doc_id", "prediction", "correct", "unparsed")


@query("exported_answers", "SELECT doc_id, source AS problem, lang AS answer, 'complete' AS status, doc_id % 2 = 0 AS truncated FROM documents ORDER BY doc_id::VARCHAR")
def exported_answers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    questions = docs.select("doc_id", F.col("source").alias("problem"), F.col("lang").alias("answer"))
    responses = docs.select("doc_id", F.concat(F.lit("<think>a</think>"), "lang").alias("response"), F.when(F.col("doc_id") % 2 == 0, "length").otherwise("stop").alias("finish_reason"))
    return pool.exported_answers(questions, responses, ["doc_id"]).select("doc_id", "problem", "answer", "status", "truncated")


@query("pool_selection", "SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND source <> 'src1' AND doc_id % 11 <> 0 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)")
def pool_selection(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("question_type"), F.col("source").alias("sub_source"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 11 != 0).alias("a"), (F.col("doc_id") % 11 != 0).alias("b"))
    return pool.selected_pool(rows, table(spark, sf_dir, "labels"), "doc_id", ["en", "de"], ["src1"], ["a", "b"]).select("doc_id")


@query("cached_steps", "SELECT user_id, event_id FROM (SELECT *, lag(event_type) OVER w AS b, lag(event_id) OVER w AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE event_id % 2 = 0 AND (p IS NULL OR event_type IS DISTINCT FROM b)")
def cached_steps(spark, sf_dir):
    own = table(spark, sf_dir, "events").withColumn("cached", F.col("event_id") % 2 == 0)
    return pool.cached_mismatches(own, "user_id", "event_id", "cached", "event_type").select("user_id", "event_id")


@query("policy_means", "SELECT event_type, 'value' AS name, round(avg(value), 6) AS mean, count(value) AS n FROM events GROUP BY 1 UNION ALL SELECT event_type, 'user' AS name, round(avg(user_id), 6) AS mean, count(user_id) AS n FROM events GROUP BY 1")
def policy_means(spark, sf_dir):
    own = table(spark, sf_dir, "events").select("event_type", F.create_map(F.lit("value"), F.col("value"), F.lit("user"), F.col("user_id").cast("double")).alias("m"))
    return pool.map_means(own, ["event_type"], "m").select("event_type", "name", F.round("mean", 6).alias("mean"), "n")


@query("budget_violations", "SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey % 100 + l_suppkey % 100 AS total FROM lineitem WHERE l_partkey % 100 + l_suppkey % 100 > 120")
def budget_violations(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 100).alias("reasoning"), (F.col("l_suppkey") % 100).alias("answer"))
    return checks.over_budget(own, "id", ["reasoning", "answer"], F.lit(120)).select("id", "total")


@query("loss_preview", "SELECT doc_id, repeat('_', length(source)) || lang AS shown FROM documents")
def loss_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", pool.preview(F.concat("source", "lang"), F.length("source")).alias("shown"))


@query("protocol_differences", "SELECT user_id, list_sort(list(f)) AS fields FROM (SELECT user_id, 'event_type' AS f FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1 UNION ALL SELECT user_id, 'parity' FROM events GROUP BY 1 HAVING count(DISTINCT event_id % 2) > 1) GROUP BY 1")
def protocol_differences(spark, sf_dir):
    own = table(spark, sf_dir, "events").withColumn("parity", F.col("event_id") % 2)
    return pool.protocol_differences(own, "user_id", ["event_type", "parity"])


@query("pooled_ratios", "SELECT user_id, event_id, round(sum(event_id % 5) OVER w / sum(1 + event_id % 7) OVER w, 9) AS ratio FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def pooled_ratios(spark, sf_dir):
    own = table(spark, sf_dir, "events").withColumns({"part": F.col("event_id") % 5, "whole": 1 + F.col("event_id") % 7})
    return own.select("user_id", "event_id", F.round(metrics.pooled_ratio("user_id", "event_id", "part", "whole", 10), 9).alias("ratio"))


@query("format_checks", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'sections_out_of_order' ELSE 'missing_final_response' END AS issues FROM documents")
def format_checks(spark, sf_dir):
    k = F.col("doc_id") % 3
    heads = [F.lit("## Planning\nx\n"), F.lit("## Solution\ny\n")]
    answer = F.when(k == 0, F.concat(*heads, F.lit("Final Answer: "), "lang")).when(k == 1, F.concat(*heads[::-1], F.lit("Final Answer: "), "lang"))
    found = spans.format_issues_of(["Planning", "Solution"], "Final Answer:")(answer)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, ",").alias("issues"))


@query("hidden_literals", "SELECT doc_id, 3::BIGINT AS n, '$x$' AS first FROM documents")
def hidden_literals(spark, sf_dir):
    text = F.concat(F.lit("so $x$ and \\frac{1}{"), F.col("doc_id").cast("string"), F.lit("} or 3x3 "))
    return table(spark, sf_dir, "documents").select("doc_id", spans.hidden_of(text).alias("h")).select("doc_id", F.size("h.literals").cast("long").alias("n"), F.get("h.literals", F.lit(0)).alias("first"))


@query("cut_responses", "SELECT doc_id, '\\boxed{' || doc_id || '}$.' AS shown FROM documents")
def cut_responses(spark, sf_dir):
    text = F.concat(F.lit("\\boxed{"), F.col("doc_id").cast("string"), F.lit("}$. and then "), "lang")
    return table(spark, sf_dir, "documents").select("doc_id", spans.cut_after_box_of(text).alias("shown"))


@query("sourced_answers", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '7' WHEN 1 THEN 'told' WHEN 2 THEN '8' ELSE lang END AS gold_answer, CASE doc_id % 4 WHEN 0 THEN 'solution:last_boxed' WHEN 1 THEN 'metadata:answer' WHEN 2 THEN 'solution:last_boxed' ELSE 'answer' END AS answer_origin FROM documents")
def sourced_answers(spark, sf_dir):
    k = F.col("doc_id") % 4
    source = F.when(k == 0, "math").when(k < 3, "s1").otherwise("numina")
    solution = F.when(k == 0, "\\boxed{7}").otherwise("x \\boxed{8}")
    found = pool.sourced_answer(source, F.col("lang"), solution, F.when(k == 1, F.create_map(F.lit("Answer"), F.lit("told"))).otherwise(F.create_map(F.lit("year"), F.lit("1"))))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("a")).select("doc_id", "a.*")


@query(
    "sampling_summary",
    """WITH s AS (SELECT doc_id % 9 AS c, doc_id % 3 AS k, n_chars FROM documents WHERE doc_id % 9 < 3)
    SELECT 'source_rows' AS metric, '' AS name, count(*)::BIGINT AS value FROM documents
    UNION ALL SELECT 'selected_rows', '', count(*) FROM s UNION ALL SELECT 'unselected_rows', '', count(*) FROM documents WHERE doc_id % 9 >= 3
    UNION ALL SELECT 'responses', '', 8 * count(*) FROM s
    UNION ALL SELECT 'num_correct', i::VARCHAR, (SELECT count(*) FROM s WHERE c = i) FROM range(0, 9) t(i)
    UNION ALL SELECT 'response_tokens', '', sum(8 * n_chars)::BIGINT FROM s
    UNION ALL SELECT 'empty_extractions', '', sum(8 - c)::BIGINT FROM s
    UNION ALL SELECT 'grading_errors', '', sum(k)::BIGINT FROM s
    UNION ALL SELECT 'finish_reasons', 'length', sum(k)::BIGINT FROM s UNION ALL SELECT 'finish_reasons', 'stop', sum(8 - k)::BIGINT FROM s""",
)
def sampling_summary(spark, sf_dir):
    places = F.sequence(F.lit(0), F.lit(7))
    k, c = F.col("doc_id") % 3, F.col("doc_id") % 9
    rows = table(spark, sf_dir, "documents").select(
        c.alias("num_correct"), F.array_repeat("n_chars", 8).alias("response_tokens"), F.transform(places, lambda i: F.when(i < k, "length").otherwise("stop")).alias("finish_reasons"),
        F.transform(places, lambda i: F.when(i < c, "x").otherwise("")).alias("extracted_answers"), F.transform(places, lambda i: F.when(i < k, "timeout")).alias("grading_errors"),
    )
    return metrics.sampling_summary(rows, F.col("num_correct") < 3)


@query("kept_crosstab", """SELECT d.source, count(*) FILTER (lang = 'en') AS english_kept, count(*) FILTER (lang IS DISTINCT FROM 'en') AS english_dropped,
    count(*) FILTER (quality = 1) AS good_kept, count(*) FILTER (quality IS DISTINCT FROM 1) AS good_dropped FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")  # fmt: skip
def kept_crosstab(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return metrics.crosstab(rows.withColumns({"english": F.col("lang") == "en", "good": F.col("quality") == 1}), ["source"], ["english", "good"])


@query("grade_counts", "SELECT l_returnflag, l_linestatus, count(*) AS rows, count(DISTINCT l_orderkey) AS problems FROM lineitem GROUP BY 1, 2")
def grade_counts(spark, sf_dir):
    return metrics.grade_counts(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_orderkey")


@query("literal_metadata", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source END AS found_source, CASE WHEN doc_id % 3 = 0 THEN (doc_id % 5)::VARCHAR END AS found_level,
    CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS entries FROM documents""")  # fmt: skip
def literal_metadata(spark, sf_dir):
    k = F.col("doc_id") % 3
    good = F.format_string("{'source': '%s', 'Level': %d, 'messages': ['a', None]}", "source", F.col("doc_id") % 5)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(k == 0, good).when(k == 1, F.lit("['source']")).otherwise(F.lit("{'source': open('x')}")).alias("metadata"))
    own = examples.literal_metadata(rows, "metadata")
    return own.select("doc_id", F.try_element_at("metadata", F.lit("source")).alias("found_source"), F.try_element_at("metadata", F.lit("Level")).alias("found_level"), F.size("metadata").alias("entries"))


@query("source_fields", "SELECT doc_id, 'q' || doc_id AS problem, source, n_chars FROM documents")
def source_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("q"), "doc_id").alias("problem"), F.struct("source", "lang", "n_chars").alias("original"))
    return rows.select("doc_id", examples.source_fields(["problem", "source", "n_chars"]).alias("fields")).select("doc_id", "fields.*")


@query("retry_seconds", """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN doc_id / 4 WHEN 4 THEN greatest(0, doc_id % 60 - 30) ELSE 0 END::DOUBLE AS seconds FROM documents""")
def retry_seconds(spark, sf_dir):
    k, now = F.col("doc_id") % 5, F.lit("2026-01-01 00:00:30 UTC").cast("timestamp")
    dated = F.concat(F.lit("Thu, 01 Jan 2026 00:00:"), F.lpad((F.col("doc_id") % 60).cast("string"), 2, "0"), F.lit(" GMT"))
    value = F.when(k == 0, (F.col("doc_id") / 4).cast("string")).when(k == 1, F.lit("-3")).when(k == 2, F.lit("later")).when(k == 4, dated)
    return table(spark, sf_dir, "documents").select("doc_id", T.retry_after(value, now).alias("seconds"))

"""Queries of envelopes, merges, training examples and text functions over stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import checks, examples
from quarry.plans.registry import query
from quarry.session import table


@query("envelope", """SELECT 'docs:train:' || doc_id::VARCHAR AS id, text AS problem, lang AS answer FROM documents""")
def envelope(spark, sf_dir):
    return examples.envelope(table(spark, sf_dir, "documents"), "docs", "train", "text", "lang", None, "doc_id").select("id", "problem", "answer")


@query("unwrapped_prompts", "SELECT doc_id, trim(text, ' ') AS problem FROM documents")
def unwrapped_prompts(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Solve this problem: "), "text").alias("prompt"))
    return own.select("doc_id", examples.unwrapped(F.col("prompt"), "Solve this problem:").alias("problem"))


@query("pool_rows", """SELECT sha256('corpus/one@r1:main:train:' || doc_id::VARCHAR) AS id, 'one' AS dataset_source, 1 AS priority, doc_id AS source_index, source AS sub_source, lang AS gold_answer, lang AS meta_type FROM documents
    UNION ALL SELECT sha256('corpus/two@r2:main:test:' || item_id::VARCHAR), 'two', 2, item_id, 'bench', item_id::VARCHAR, NULL FROM benchmark""")  # fmt: skip
def pool_rows(spark, sf_dir):
    meta = examples.allowed_metadata(F.create_map(F.lit("Type"), F.col("lang"), F.lit("secret"), F.lit("x")))
    one = examples.pool_rows(table(spark, sf_dir, "documents"), "one", 1, "corpus/one", "r1", "main", "train", "doc_id", "text", "lang", F.col("source"), meta)
    none = F.create_map().cast("map<string,string>")
    two = examples.pool_rows(table(spark, sf_dir, "benchmark"), "two", 2, "corpus/two", "r2", "main", "test", "item_id", "text", "item_id", F.lit("bench"), none)
    return one.unionByName(two).select("id", "dataset_source", "priority", "source_index", "sub_source", "gold_answer", F.try_element_at("metadata", F.lit("Type")).alias("meta_type"))


@query("merged_annotations", """SELECT doc_id, coalesce(quality::VARCHAR, 'none') AS b_responses, coalesce(toxic::BIGINT, -1) AS b_num_correct FROM documents LEFT JOIN labels USING (doc_id)""")
def merged_annotations(spark, sf_dir):
    journal = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("responses"), F.col("toxic").cast("long").alias("num_correct"))
    merged = examples.merged_annotations(table(spark, sf_dir, "documents").select("doc_id"), journal, "doc_id", "b_")
    return merged.select("doc_id", F.coalesce("b_responses", F.lit("none")).alias("b_responses"), F.coalesce("b_num_correct", F.lit(-1)).alias("b_num_correct"))


@query("aligned_tables", "SELECT coalesce(d.doc_id, 2 * v.vec_id) AS doc_id, d.doc_id IS NOT NULL AND v.vec_id IS NOT NULL AND d.doc_id % 3 = v.vec_id % 3 AS ok FROM documents d FULL JOIN embeddings v ON d.doc_id = 2 * v.vec_id")
def aligned_tables(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3).alias("v"))
    b = table(spark, sf_dir, "embeddings").select((2 * F.col("vec_id")).alias("doc_id"), (F.col("vec_id") % 3).alias("v"))
    return examples.aligned(a, b, "doc_id", ("v",))


@query("completeness", """SELECT coalesce(o.k, l.k) AS o_orderkey, CASE WHEN o.k IS NULL THEN 'document' ELSE 'response' END AS lacking FROM (SELECT DISTINCT o_orderkey AS k FROM orders) o FULL JOIN (SELECT DISTINCT l_orderkey + 5 AS k FROM lineitem) l ON o.k = l.k WHERE o.k IS NULL OR l.k IS NULL""")
def completeness(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + 5).alias("o_orderkey"))
    return examples.completeness(table(spark, sf_dir, "orders"), lines, "o_orderkey")


@query("pending_rows", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_rows(spark, sf_dir):
    return examples.pending(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("few_shot_prompts", """WITH d AS (SELECT 'set' || (item_id % 4) AS subject, string_agg(text || chr(10), '' ORDER BY item_id) AS prefix FROM benchmark GROUP BY 1)
    SELECT doc_id, sha256(coalesce(prefix, '') || 'Question:' || chr(10) || source || chr(10) || 'Options:' || chr(10) || 'A. ' || lang || chr(10) || 'B. none' || chr(10) || 'Answer: Let''s think step by step.') AS digest
    FROM documents LEFT JOIN d ON d.subject = 'set' || (doc_id % 5)""")  # fmt: skip
def few_shot_prompts(spark, sf_dir):
    demos = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("set"), F.col("item_id") % 4).alias("subject"), "item_id", "text")
    questions = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.concat(F.lit("set"), F.col("doc_id") % 5).alias("subject"))
    both = examples.few_shot(questions, demos, "subject", "item_id", F.concat("text", F.lit("\n")))
    prompt = F.concat(F.coalesce("prefix", F.lit("")), examples.choice_prompt(F.col("source"), F.array(F.col("lang"), F.lit("N/A"), F.lit("none"))))
    return both.select("doc_id", F.sha2(prompt, 256).alias("digest"))


CONV = "u AS (SELECT conv_id, turn, text, len(string_split(text, ' ')) AS n FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, text, len(string_split(text, ' ')) AS n FROM conversations WHERE role = 'assistant')"


@query("training_examples", f"""WITH {CONV} SELECT u.conv_id, u.turn, (u.n + a.n)::BIGINT AS tokens, CASE WHEN trim(coalesce(a.text, '')) = '' THEN 'missing_output' WHEN u.n + a.n > 300 THEN 'overlength' ELSE 'kept' END AS state, (-100 * u.n + a.n)::BIGINT AS label_sum,
    sha256('<|im_start|>system' || chr(10) || 'Reason.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || u.text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) AS prompt FROM u JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1""")  # fmt: skip
def training_examples(spark, sf_dir):
    own = table(spark, sf_dir, "conversations")
    u = own.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("problem"))
    a = own.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    both = u.join(a, ["conv_id", "turn"])
    ones = lambda c: F.transform(F.split(c, " "), lambda _: F.lit(1).cast("long"))
    told = examples.trainable(both, F.size(F.split("problem", " ")) + F.size(F.split("response", " ")), 300)
    made = told.withColumn("labels", examples.labels(ones("problem"), ones("response")))
    total = F.aggregate("labels", F.lit(0).cast("long"), lambda s, x: s + x)
    prompt = examples.chat(F.lit("Reason."), F.col("problem"))
    return made.select("conv_id", "turn", F.size("labels").cast("long").alias("tokens"), F.coalesce("drop", F.lit("kept")).alias("state"), total.alias("label_sum"), F.sha2(prompt, 256).alias("prompt"))


@query("collated_batches", """WITH b AS (SELECT doc_id, CAST(floor(doc_id / 8) AS BIGINT) AS batch, len(string_split(text, ' ')) AS n FROM documents) SELECT doc_id, batch, (max(n) OVER (PARTITION BY batch))::BIGINT AS width, n::BIGINT AS own FROM b""")
def collated_batches(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", " "), lambda _: F.lit(1).cast("long")).alias("ids"))
    made = examples.collated(own, "doc_id", 8, "ids", 0)
    return made.select("doc_id", "batch", F.size("ids").cast("long").alias("width"), F.size(F.filter("ids", lambda x: x == 1)).cast("long").alias("own"))


@query("integer_gold_rows", "SELECT doc_id, doc_id::VARCHAR AS gold FROM documents WHERE length(text) <= 2000")
def integer_gold_rows(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("gold"), "text")
    return examples.integer_gold(own, "gold", F.length("text"), 2000).select("doc_id", "gold")


@query("trimmed_answers", "SELECT lang, count(*) FILTER (regexp_replace(html || '  ', '\\s+$', '') <> html || '  ') AS changed, sum(length(regexp_replace(html || '  ', '\\s+$', '')))::BIGINT AS chars FROM (SELECT regexp_extract(url, '/([a-z][a-z])/', 1) AS lang, html FROM pages) GROUP BY lang")
def trimmed_answers(spark, sf_dir):
    own = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "/([a-z][a-z])/", 1).alias("lang"), F.concat("html", F.lit("  ")).alias("html"))
    return examples.trimmed(own, "html").groupBy("lang").agg(F.count_if("changed").alias("changed"), F.sum(F.length("html")).cast("long").alias("chars"))


@query("completion_budgets", "SELECT doc_id, least(4096, 40000 - length(text)) AS budget FROM documents")
def completion_budgets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", examples.completion_budget(F.length("text"), 40000, 4096).cast("long").alias("budget"))


@query("duplicate_keys", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return checks.duplicates(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("partition_check", "SELECT doc_id FROM documents WHERE doc_id % 10 = 3")
def partition_check(spark, sf_dir):
    whole = table(spark, sf_dir, "documents").select("doc_id")
    return checks.not_a_partition(whole, [whole.filter("doc_id % 10 < 4"), whole.filter("doc_id % 10 > 2")], "doc_id").select("doc_id")


@query("changed_rows", "SELECT doc_id FROM documents WHERE doc_id % 7 = 0 AND source <> 'src0'")
def changed_rows(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return checks.changed(own, own.withColumn("source", F.when(F.col("doc_id") % 7 == 0, "src0").otherwise(F.col("source"))), "doc_id", "source", "lang")


@query("json_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, sha256('[' || event_id::VARCHAR || ', \"' || event_type || '\"]') AS digest FROM events")
def json_fields(spark, sf_dir):
    own = table(spark, sf_dir, "events")
    canonical = F.concat(F.lit("["), F.col("event_id").cast("string"), F.lit(', "'), "event_type", F.lit('"]'))
    return own.select("event_id", F.expr("try_cast(get_json_object(props, '$.k') AS BIGINT)").alias("k"), F.sha2(canonical, 256).alias("digest"))


ANSWERS = """a AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'The answer is (B). The answer is C.' WHEN 1 THEN 'answer: **d**' WHEN 2 THEN ' (A). ' WHEN 3 THEN 'So the answer is J!' ELSE lang END AS t FROM documents)"""


def answers(spark, sf_dir):
    k = F.col("doc_id") % 5
    t = F.when(k == 0, "The answer is (B). The answer is C.").when(k == 1, "answer: **d**").when(k == 2, " (A). ").when(k == 3, "So the answer is J!").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))


@query("choice_answers", f"WITH {ANSWERS} SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'C' WHEN 1 THEN 'D' WHEN 2 THEN 'A' END AS choice FROM a")
def choice_answers(spark, sf_dir):
    return answers(spark, sf_dir).select("doc_id", T.choice_answer(F.col("t"), F.array(*map(F.lit, "ABCD"))).alias("choice"))


@query("declared_answers", f"WITH {ANSWERS} SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'C' WHEN 1 THEN t WHEN 2 THEN '(A)' WHEN 3 THEN 'J!' ELSE t END AS plain, CASE doc_id % 5 WHEN 0 THEN '(C)' WHEN 2 THEN '(A)' END AS option FROM a")
def declared_answers(spark, sf_dir):
    return answers(spark, sf_dir).select("doc_id", T.declared_answer(F.col("t"), F.lit("x")).alias("plain"), T.declared_answer(F.col("t"), F.lit("(A)")).alias("option"))


@query("split_reasoning", "SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN lang END AS reasoning, CASE doc_id % 3 WHEN 0 THEN source WHEN 2 THEN source || lang END AS answer, CASE doc_id % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'unclosed' ELSE 'none' END AS status FROM documents")
def split_reasoning(spark, sf_dir):
    k = F.col("doc_id") % 3
    t = F.when(k == 0, F.concat(F.lit("<think> "), "lang", F.lit(" </think> "), "source")).when(k == 1, F.concat(F.lit("<think>"), "lang")).otherwise(F.concat("source", "lang"))
    return table(spark, sf_dir, "documents").select("doc_id", T.split_reasoning(t).alias("s")).select("doc_id", "s.*")


@query("script_ratios", r"SELECT doc_id, round(CASE WHEN length(regexp_replace(t, '[^\p{L}]', '', 'g')) > 0 THEN length(regexp_replace(t, '[^\x{ac00}-\x{d7a3}\x{1100}-\x{11ff}\x{3130}-\x{318f}]', '', 'g')) / length(regexp_replace(t, '[^\p{L}]', '', 'g')) ELSE 0 END, 6) AS ratio FROM (SELECT doc_id, repeat('한글', (doc_id % 4)::INT) || text AS t FROM documents)")
def script_ratios(spark, sf_dir):
    own = table(spark, sf_dir, "documents")
    return own.select("doc_id", F.round(T.hangul_ratio(F.concat(F.expr("repeat('한글', CAST(doc_id % 4 AS INT))"), "text")), 6).alias("ratio"))


@query("redacted_errors", "SELECT doc_id, sha256(substr(regexp_replace('key sk-' || source || '_x- ' || text, 'sk-[A-Za-z0-9_-]+', '[redacted]', 'g'), 1, 2000)) AS digest FROM documents")
def redacted_errors(spark, sf_dir):
    own = table(spark, sf_dir, "documents")
    return own.select("doc_id", F.sha2(T.redacted(F.concat(F.lit("key sk-"), "source", F.lit("_x- "), "text")), 256).alias("digest"))


@query("lexical_forms", r"SELECT doc_id, sha256(array_to_string(regexp_extract_all(regexp_replace(lower(text), '\$', ' ', 'g'), '([\p{L}\p{Nl}\p{No}]+|\p{Nd}+)'), ' ')) AS digest FROM documents")
def lexical_forms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normal_lexical(F.col("text")), 256).alias("digest"))


@query("graded_answers", """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 3 THEN '' ELSE (2 * CAST(l_quantity AS BIGINT))::VARCHAR || '/' || '2' END AS answer, l_linenumber % 4 <> 3 AND l_suppkey % 2 = 0 AS correct, CASE l_linenumber % 4 WHEN 3 THEN 'malformed_box' WHEN 2 THEN 'explicit_final' ELSE 'boxed' END AS method FROM lineitem""")
def graded_answers(spark, sf_dir):
    from quarry.functions.grading import graded_of

    k = F.col("l_linenumber") % 4
    value = F.concat((2 * F.col("l_quantity")).cast("long").cast("string"), F.lit("/2"))
    response = F.when(k == 3, "\\boxed{1").when(k == 2, F.concat(F.lit("Work. Therefore, the answer is "), value, F.lit("."))).otherwise(F.concat(F.lit("so $\\boxed{"), value, F.lit("}$")))
    gold = F.when(F.col("l_suppkey") % 2 == 0, F.col("l_quantity").cast("long").cast("string")).otherwise("0.5")
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", graded_of(response, gold, F.lit(""), F.lit(None).cast("string")).alias("g"))
    return own.select("l_orderkey", "l_linenumber", "g.*")


@query("boxed_answers", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE '\\frac{' || doc_id::VARCHAR || '}{2}' END AS boxed FROM documents")
def boxed_answers(spark, sf_dir):
    from quarry.functions.spans import last_boxed_of

    box = F.concat(F.lit("\\boxed{\\frac{"), F.col("doc_id").cast("string"), F.lit("}{2}"), F.when(F.col("doc_id") % 3 == 0, "").otherwise("}"))
    return table(spark, sf_dir, "documents").select("doc_id", last_boxed_of(F.concat(F.lit("\\boxed{0} "), box, F.lit(" "), "text")).alias("boxed"))


@query("paragraph_chunks")
def paragraph_chunks(spark, sf_dir):
    from quarry.functions.spans import paragraphs_of

    own = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(paragraphs_of(F.replace("text", F.lit("\n"), F.lit("\n\n")))).alias("place", "part"))
    return own.select("doc_id", "place", F.sha2("part", 256).alias("digest"))


@query("translation_checks")
def translation_checks(spark, sf_dir):
    from quarry.functions.spans import translation_issues

    own = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.regexp_replace("text", "[0-4]", "7")).alias("target"))
    told = own.select("doc_id", translation_issues(0.5, 2.0)("text", "target").alias("issues"))
    named = told.select(F.explode("issues").alias("issue")).select(F.regexp_extract("issue", "^(?:soft:)?[^:]+", 0).alias("issue"))
    return named.groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


@query("review_queue", """SELECT doc_id, n_bad, chars FROM (SELECT doc_id, (length(text) > 5000)::BIGINT + (lang <> 'en')::BIGINT AS n_bad, length(text) AS chars FROM documents) WHERE n_bad > 0 ORDER BY n_bad DESC, chars DESC, doc_id""")
def review_queue(spark, sf_dir):
    n = (F.length("text") > 5000).cast("long") + (F.col("lang") != "en").cast("long")
    own = table(spark, sf_dir, "documents").select("doc_id", n.alias("n_bad"), F.length("text").cast("long").alias("chars")).filter("n_bad > 0")
    return own.orderBy(F.desc("n_bad"), F.desc("chars"), "doc_id")


@query("whole_groups", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 4 AND count(DISTINCT l_linenumber) = 4)")
def whole_groups(spark, sf_dir):
    from quarry.streaming.journal import whole_groups as whole

    return whole(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", 4).select("l_orderkey", "l_linenumber")


@query("latest_status", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'purchase'")
def latest_status(spark, sf_dir):
    from quarry.streaming.journal import latest_status as latest
    from quarry.streaming.journal import to_retry

    return to_retry(latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id"), "event_type", "purchase").select("user_id", "event_type")


@query("worker_assignment", "SELECT doc_id % 8 AS worker, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def worker_assignment(spark, sf_dir):
    from quarry.streaming.journal import assigned

    return assigned(table(spark, sf_dir, "documents"), "doc_id", 8).groupBy("worker").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))


@query("step_log_profile", """SELECT event_type AS log, count(*) AS records, 0::BIGINT AS malformed, min(event_id) AS first_step, max(event_id) AS last_step, 0::BIGINT AS repeated_steps, 'm.k,step' AS fields FROM events GROUP BY 1""")
def step_log_profile(spark, sf_dir):
    from quarry.sources.tables import step_log_profile as profile

    lines = table(spark, sf_dir, "events").select(F.col("event_type").alias("log"), F.concat(F.lit('{"step": '), F.col("event_id").cast("string"), F.lit(', "m": '), "props", F.lit("}")).alias("line"))
    return profile(lines, "log", "line")

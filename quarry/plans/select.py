"""Selection queries over stand-ins: users and orders are groups, events and lines their rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import select
from quarry.plans.registry import query
from quarry.session import table


@query("latest_by_user", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_by_user(spark, sf_dir):
    return select.latest(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("first_documents", "SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY ALL")
def first_documents(spark, sf_dir):
    return select.first_of(table(spark, sf_dir, "documents"), ["lang", "source"], ["doc_id"]).select("lang", "source", "doc_id")


RANK = """sha256('[42, "' || {0}::VARCHAR || '", "' || {1}::VARCHAR || '"]')"""


@query("hash_ranked_sample", f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {RANK.format('source', 'doc_id')}, doc_id::VARCHAR) AS n FROM documents) WHERE n <= 7")
def hash_ranked_sample(spark, sf_dir):
    return select.ranked(table(spark, sf_dir, "documents"), "source", F.col("doc_id"), 7, 42).select("source", "doc_id")


@query("quota_sample", f"""SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {RANK.format('lang', 'doc_id')}, doc_id::VARCHAR) AS n FROM documents)
    WHERE n <= CASE lang WHEN 'en' THEN 40 WHEN 'de' THEN 25 WHEN 'fr' THEN 10 ELSE 0 END""")  # fmt: skip
def quota_sample(spark, sf_dir):
    return select.quotas(table(spark, sf_dir, "documents"), "lang", F.col("doc_id"), {"en": 40, "de": 25, "fr": 10}, 42).select("lang", "doc_id")


@query("share_capped_sample", f"""WITH o AS (SELECT count(*) AS others FROM documents WHERE lang IS DISTINCT FROM 'en')
    SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {RANK.format('lang', 'doc_id')}, doc_id::VARCHAR) AS n FROM documents), o WHERE lang IS DISTINCT FROM 'en' OR n <= floor(others * 0.4 / (1 - 0.4))""")  # fmt: skip
def share_capped_sample(spark, sf_dir):
    return select.share_capped(table(spark, sf_dir, "documents"), "lang", "en", 0.4, F.col("doc_id"), 42).select("lang", "doc_id")


@query("random_third", """SELECT doc_id FROM documents WHERE CAST('0x' || substr(sha256('[42, "' || doc_id::VARCHAR || '"]'), 1, 8) AS BIGINT) / 4294967296.0 < 1.0 / 3""")
def random_third(spark, sf_dir):
    return select.share(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), 42, 1 / 3)


@query("candidate_order", "SELECT o_orderkey, sha256('42:3:' || o_orderkey::VARCHAR) AS rank FROM orders ORDER BY rank")
def candidate_order(spark, sf_dir):
    return select.shuffled(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("o_orderkey"), 42, 3)


@query("derived_seeds", "SELECT doc_id, CAST('0x' || substr(sha256('42:' || doc_id::VARCHAR), 1, 8) AS BIGINT) AS seed, CAST('0x' || substr(sha256('42:' || doc_id::VARCHAR), 1, 8) AS BIGINT) % 2147483648 AS sample_seed FROM documents")
def derived_seeds(spark, sf_dir):
    seed = T.derived_seed(F.lit("42"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", seed.alias("seed"), F.pmod(seed, F.lit(2147483648)).alias("sample_seed"))


@query("longest_examples", "SELECT doc_id, length(text) AS chars FROM documents ORDER BY length(text) DESC, doc_id LIMIT 20")
def longest_examples(spark, sf_dir):
    return select.longest(table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("chars")), F.col("chars"), "doc_id", 20)


GROUPS = """s AS (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) AS x FROM (SELECT DISTINCT l_orderkey FROM lineitem)),
    per AS (SELECT l_orderkey AS id, l_orderkey AS ord, count(*) AS n, count(*) FILTER (l_discount > 0.045) AS correct FROM lineitem GROUP BY 1 HAVING count(*) = 4),
    g AS (SELECT id, ord, correct, correct > 0 AND correct < 4 AS mixed, CAST(floor(ord / 64) AS BIGINT) AS batch FROM per),
    r AS (SELECT *, sum(mixed::INT) OVER (ORDER BY ord) AS running FROM g),
    b AS (SELECT batch, coalesce(sum(sum(mixed::INT)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g GROUP BY batch),
    told AS (SELECT id, ord, batch, correct, mixed, mixed AND running <= 100 AS accepted, before < 100 AS ran FROM r JOIN b USING (batch))"""


def groups(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_orderkey").alias("ord"), (F.col("l_discount") > 0.045).alias("correct"))
    return select.mixed_groups(own, "id", "ord", 4, 64, 100)


@query("mixed_groups", f"WITH {GROUPS} SELECT id, ord, batch, correct, mixed, accepted, ran FROM told")
def mixed_groups(spark, sf_dir):
    return groups(spark, sf_dir)


@query("rollout_stats", f"WITH {GROUPS} SELECT count(*) AS candidates, count(*) FILTER (mixed) AS mixed, count(*) FILTER (correct = 4) AS all_correct, count(*) FILTER (correct = 0) AS all_wrong, count(*) FILTER (accepted) AS retained, round(count(*) FILTER (mixed) / count(*), 6) AS acceptance_rate FROM told WHERE ran")
def rollout_stats(spark, sf_dir):
    return select.rollout_stats(groups(spark, sf_dir), 4).withColumn("acceptance_rate", F.round("acceptance_rate", 6))


@query("minibatch_totals", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY floor(o_orderkey / 32)), 2) AS total FROM orders")
def minibatch_totals(spark, sf_dir):
    own = table(spark, sf_dir, "orders")
    return own.select("o_orderkey", F.round(select.minibatch_totals(own, "o_orderkey", 32, "o_totalprice"), 2).alias("total"))


@query("pass_count_selection", "SELECT l_orderkey AS id, least(count(*) FILTER (l_discount > 0.045), 8) AS num_correct FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_discount > 0.045) IN (0, 1, 2)")
def pass_count_selection(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.least(F.count_if(F.col("l_discount") > 0.045), F.lit(8)).alias("num_correct"))
    return select.pass_counts(own, "num_correct")


@query("preferred_first", f"""SELECT doc_id FROM documents LEFT JOIN (SELECT DISTINCT doc_id, 0 AS w FROM labels WHERE toxic = 1) USING (doc_id) ORDER BY coalesce(w, 1), sha256('[42, "' || doc_id::VARCHAR || '"]') LIMIT 100""")
def preferred_first(spark, sf_dir):
    return select.preferred_first(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id", 100, 42)


@query("longest_and_fill", f"""WITH l AS (SELECT lang, arg_max(doc_id, (length(text), -doc_id)) AS doc_id FROM documents GROUP BY lang)
    SELECT lang, doc_id FROM l UNION ALL SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {RANK.format('lang', 'doc_id')}, doc_id::VARCHAR) AS n FROM documents WHERE (lang, doc_id) NOT IN (SELECT lang, doc_id FROM l)) WHERE n <= 4""")  # fmt: skip
def longest_and_fill(spark, sf_dir):
    return select.longest_and_fill(table(spark, sf_dir, "documents"), "lang", "doc_id", F.length("text"), 5, 42).select("lang", "doc_id")

"""Metric queries over stand-ins: an order is a problem and its lines are samples; events are step logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import metrics
from quarry.plans.registry import query
from quarry.session import table

SAMPLES = """samples AS (SELECT l_orderkey AS id, (l_suppkey % 7)::VARCHAR AS mode, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS sample_index,
    l_discount > 0.045 AS correct, l_quantity AS tokens, l_returnflag = 'R' AS truncated, l_linestatus AS status FROM lineitem)"""


def samples(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem")
    return own.select(F.col("l_orderkey").alias("id"), "l_linenumber", (F.col("l_suppkey") % 7).cast("string").alias("mode"), (F.col("l_discount") > 0.045).alias("correct"), F.col("l_quantity").alias("tokens"), (F.col("l_returnflag") == "R").alias("truncated"), F.col("l_linestatus").alias("status"))


def r6(frame):
    return frame.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in frame.dtypes])


def product(k: int) -> str:
    return "1.0 - " + " * ".join(f"((n - c - {i})::DOUBLE / (n - {i}))" for i in range(k))


def pass_sql(k: int) -> str:
    return f"CASE WHEN n < {k} THEN NULL WHEN n - c < {k} THEN 1.0 ELSE {product(k)} END"


@query("pass_at_k", f"""WITH {SAMPLES}, per AS (SELECT status, id, count(*) AS n, count(*) FILTER (correct) AS c, sum(tokens) AS t, sum(tokens) FILTER (correct) AS tc FROM samples GROUP BY ALL)
    SELECT status, count(*) AS problems, sum(n)::BIGINT AS responses, round(sum(c) / sum(n), 6) AS avg, round(avg({pass_sql(1)}), 6) AS pass_1, round(avg({pass_sql(2)}), 6) AS pass_2, round(avg({pass_sql(4)}), 6) AS pass_4,
    round(sum(t) / sum(n), 6) AS tokens_all, round(sum(tc) / nullif(sum(c), 0), 6) AS tokens_correct, round((sum(t) - coalesce(sum(tc), 0)) / nullif(sum(n) - sum(c), 0), 6) AS tokens_incorrect FROM per GROUP BY status""")  # fmt: skip
def pass_at_k(spark, sf_dir):
    return r6(metrics.sample_metrics(samples(spark, sf_dir), ["status"], (1, 2, 4)))


@query("incomplete_groups", """SELECT l_orderkey AS id, count(*) AS many, count(DISTINCT l_linenumber) AS distinct_n, min(l_linenumber) - 1 AS low, max(l_linenumber) - 1 AS high FROM lineitem
    GROUP BY 1 HAVING count(*) <> 4 OR count(DISTINCT l_linenumber) <> 4 OR min(l_linenumber) <> 1 OR max(l_linenumber) <> 4""")  # fmt: skip
def incomplete_groups(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") - 1).alias("sample_index"))
    return metrics.incomplete_groups(own, 4).withColumnRenamed("distinct", "distinct_n")


@query("accuracy_rollup", f"""WITH {SAMPLES}, r AS (SELECT status AS benchmark, mode AS subject, grouping(mode) AS g, count(*) AS problems, (count(*) FILTER (correct))::DOUBLE AS correct, 100 * avg(correct::INT) AS accuracy, avg(tokens) AS tokens, 100 * avg(truncated::INT) AS truncated
    FROM samples GROUP BY GROUPING SETS ((status, mode), (status)))
    SELECT benchmark, CASE WHEN g = 1 THEN 'overall' ELSE subject END AS subject, problems, correct, round(accuracy, 6) AS accuracy, round(tokens, 6) AS tokens, round(truncated, 6) AS truncated FROM r
    UNION ALL SELECT benchmark, 'task_macro', sum(problems)::BIGINT, NULL, round(avg(accuracy), 6), NULL, NULL FROM r WHERE g = 0 GROUP BY benchmark""")  # fmt: skip
def accuracy_rollup(spark, sf_dir):
    own = samples(spark, sf_dir).select(F.col("status").alias("benchmark"), F.col("mode").alias("subject"), "correct", "tokens", "truncated")
    return r6(metrics.accuracy_rollup(own).withColumn("correct", F.col("correct").cast("double")))


@query("instruction_accuracy", """WITH a AS (SELECT l_orderkey, list(l_tax < 0.06) AS x FROM lineitem GROUP BY 1)
    SELECT count(*) AS prompts, count(*) FILTER (list_bool_and(x)) AS prompts_followed, sum(len(x))::BIGINT AS instructions, sum(len(list_filter(x, lambda v: v)))::BIGINT AS instructions_followed FROM a""")  # fmt: skip
def instruction_accuracy(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_tax") < 0.06).alias("x"))
    return metrics.instruction_accuracy(own, "x")


@query("comparison_pivot", """SELECT o_orderpriority AS model, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 4) AS "F", round(avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 4) AS "O", round(avg(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 4) AS "P" FROM orders GROUP BY 1""")
def comparison_pivot(spark, sf_dir):
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("model"), "o_orderstatus").agg(F.round(F.avg("o_totalprice"), 4).alias("v"))
    return metrics.comparison(own, "model", "o_orderstatus", "v", ["F", "O", "P"])


@query("parent_deltas", """WITH n AS (SELECT c_nationkey AS key, c_nationkey - 5 AS parent, round(avg(c_acctbal), 4) AS value FROM customer GROUP BY 1)
    SELECT n.key, n.parent, n.value, round(n.value - p.value, 4) AS delta FROM n LEFT JOIN n p ON p.key = n.parent""")  # fmt: skip
def parent_deltas(spark, sf_dir):
    own = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.round(F.avg("c_acctbal"), 4).alias("value")).withColumn("parent", F.col("key") - 5)
    return metrics.parent_deltas(own, "key", "parent", "value").withColumn("delta", F.round("delta", 4))


@query("correct_histogram", f"""WITH {SAMPLES}, per AS (SELECT id, count(*) FILTER (correct) AS num_correct FROM samples GROUP BY id)
    SELECT v AS num_correct, count(per.id) AS n FROM (SELECT unnest(generate_series(0, 8)) AS v) LEFT JOIN per ON num_correct = v GROUP BY v""")  # fmt: skip
def correct_histogram(spark, sf_dir):
    return metrics.histogram(samples(spark, sf_dir).groupBy("id").agg(F.count_if("correct").alias("num_correct")), "num_correct", 0, 8)


@query("length_stats", """SELECT lang, count(n) AS n, sum(n)::BIGINT AS total, min(n) AS low, quantile_cont(n, 0.5) AS median, round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.99), 6) AS p99, max(n) AS high
    FROM (SELECT lang, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) AS n FROM documents) GROUP BY lang""")  # fmt: skip
def length_stats(spark, sf_dir):
    words = F.filter(F.split("text", r"[ \t\n\r\f\x0b]+"), lambda w: w != "")
    own = table(spark, sf_dir, "documents").select("lang", F.size(words).cast("long").alias("n"))
    return r6(metrics.length_stats(own, ["lang"], "n"))


STEPS = """steps AS (SELECT event_type AS run, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS step, count(*) AS generated, count(*) FILTER (value > 50) AS correct, avg(value) AS loss FROM events GROUP BY ALL)"""


def steps(spark, sf_dir):
    own = table(spark, sf_dir, "events")
    return own.groupBy(F.col("event_type").alias("run"), F.floor(F.unix_timestamp("ts") / 86400).alias("step")).agg(
        F.count(F.lit(1)).alias("generated"), F.count_if(F.col("value") > 50).alias("correct"), F.avg("value").alias("loss")
    )


@query("moving_average", f"""WITH {STEPS} SELECT run, step, round(avg(loss) OVER w, 6) AS loss_avg, round(sum(correct) OVER t / sum(generated) OVER t, 6) AS ratio FROM steps
    WINDOW w AS (PARTITION BY run ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), t AS (PARTITION BY run ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")  # fmt: skip
def moving_average(spark, sf_dir):
    own = steps(spark, sf_dir)
    return r6(own.select("run", "step", metrics.moving_average(own, "run", "step", F.col("loss"), 5).alias("loss_avg"), metrics.pooled_ratio("run", "step", "correct", "generated", 10).alias("ratio")))


@query("spliced_series", f"""WITH {STEPS}, m AS (SELECT run, step - min(step) OVER (PARTITION BY run) AS step, generated, loss FROM steps)
    SELECT run, step, generated FROM m WHERE run = 'click' AND step <= 10 UNION ALL SELECT 'click', step, generated FROM m WHERE run = 'view' AND step > 10""")  # fmt: skip
def spliced_series(spark, sf_dir):
    own = steps(spark, sf_dir)
    low = own.groupBy("run").agg(F.min("step").alias("low"))
    own = own.join(low, "run").select("run", (F.col("step") - F.col("low")).alias("step"), "generated")
    return metrics.splice(own.filter("run = 'click'"), own.filter("run = 'view'").withColumn("run", F.lit("click")), "step", 10)


@query("series_gaps", """WITH u AS (SELECT DISTINCT user_id AS run, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS step FROM events)
    SELECT run, step, before FROM (SELECT run, step, lag(step) OVER (PARTITION BY run ORDER BY step) AS before FROM u) WHERE before IS NOT NULL AND step <> before + 1""")  # fmt: skip
def series_gaps(spark, sf_dir):
    days = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.floor(F.unix_timestamp("ts") / 86400).alias("step")).distinct()
    return metrics.gaps(days, "run", "step")


@query("edge_windows", f"""WITH {STEPS}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS u, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS d FROM steps)
    SELECT run, count(*) AS steps, round(sum(correct) FILTER (u <= 20) / sum(generated) FILTER (u <= 20), 6) AS first_ratio, round(sum(correct) FILTER (d <= 20) / sum(generated) FILTER (d <= 20), 6) AS last_ratio FROM r GROUP BY run""")  # fmt: skip
def edge_windows(spark, sf_dir):
    return r6(metrics.edge_windows(steps(spark, sf_dir), "run", "step", "correct", "generated", 20))


@query("epoch_means", "SELECT CAST(ceil(value / 20 - 1e-8) AS BIGINT) AS epoch_nr, round(avg(value), 6) AS mean, count(*) AS records FROM events GROUP BY 1")
def epoch_means(spark, sf_dir):
    return r6(metrics.epoch_means(table(spark, sf_dir, "events").withColumn("epoch", F.col("value") / 20), "epoch", "value"))


@query("regrade_changes", """WITH a AS (SELECT l_orderkey, list(l_discount > 0.045 ORDER BY l_linenumber) AS o, list(l_discount > 0.055 ORDER BY l_linenumber) AS w FROM lineitem GROUP BY 1)
    SELECT count(*) AS rows, sum(len(list_filter(o, lambda v: v)))::BIGINT AS old_correct, sum(len(list_filter(w, lambda v: v)))::BIGINT AS new_correct,
    sum(len(list_filter(list_zip(o, w), lambda p: p[1] <> p[2])))::BIGINT AS changed_flags, count(*) FILTER (len(list_filter(list_zip(o, w), lambda p: p[1] <> p[2])) > 0) AS changed_rows FROM a""")  # fmt: skip
def regrade_changes(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", (F.col("l_discount") > 0.045).alias("o"), (F.col("l_discount") > 0.055).alias("w")))).alias("x"))
    return metrics.regrade_changes(own.select(F.transform("x", lambda v: v["o"]).alias("o"), F.transform("x", lambda v: v["w"]).alias("w")), "o", "w")


@query("shaped_rewards", "SELECT l_orderkey, l_linenumber, round((CASE WHEN l_discount > 0.045 THEN 1.0 ELSE -1.0 END) - greatest(0, l_quantity - 30) / 20.0, 6) AS reward FROM lineitem")
def shaped_rewards(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem")
    return own.select("l_orderkey", "l_linenumber", F.round(metrics.reward(F.col("l_discount") > 0.045, F.col("l_quantity"), 30, 50), 6).alias("reward"))


@query("group_relative_rewards", """SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER w) / nullif(stddev_samp(l_quantity) OVER w, 0), 6) AS scaled FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""")
def group_relative_rewards(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem")
    return own.select("l_orderkey", "l_linenumber", F.round(metrics.group_relative(F.col("l_quantity"), "l_orderkey"), 6).alias("scaled"))


@query("benchmark_counts", """WITH want(lang, expected) AS (VALUES ('en', 620), ('de', 129), ('it', 5))
    SELECT coalesce(w.lang, h.lang) AS lang, coalesce(expected, -1)::BIGINT AS expected, coalesce(n, 0) AS n, expected IS NOT DISTINCT FROM coalesce(n, 0) AS ok FROM want w FULL JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) h ON w.lang = h.lang""")  # fmt: skip
def benchmark_counts(spark, sf_dir):
    return metrics.expected_counts(table(spark, sf_dir, "documents"), "lang", {"en": 620, "de": 129, "it": 5}).withColumn("expected", F.coalesce("expected", F.lit(-1)))


@query("usage_totals", """SELECT user_id, count(*) AS attempts, sum(coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0))::BIGINT AS total FROM events GROUP BY user_id""")
def usage_totals(spark, sf_dir):
    own = table(spark, sf_dir, "events")
    k = F.coalesce(F.expr("try_cast(get_json_object(props, '$.k') AS BIGINT)"), F.lit(0))
    return own.groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts"), F.sum(k).alias("total"))

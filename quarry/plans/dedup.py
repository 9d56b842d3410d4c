"""Deduplication queries over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import dedup
from quarry.plans.registry import query
from quarry.session import table

#: The lexical normal form in the oracle's dialect (documents hold no LaTeX, so layout commands need no rule there).
LEXICAL = r"""array_to_string(regexp_extract_all(regexp_replace(lower({0}), '\$', ' ', 'g'), '([\p{{L}}\p{{Nl}}\p{{No}}]+|\p{{Nd}}+)'), ' ')"""
FORMS = f"forms AS (SELECT doc_id AS id, source, lang, {LEXICAL.format('text')} AS norm FROM documents)"


def rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source", "lang")


@query("exact_clusters", f"WITH {FORMS}, c AS (SELECT norm, min(id) AS root, count(*) AS members FROM forms GROUP BY norm) SELECT id, root, members FROM forms JOIN c USING (norm)")
def exact_clusters(spark, sf_dir):
    return dedup.exact_clusters(rows(spark, sf_dir))


def links_sql(threshold: float) -> str:
    return f"""
    {FORMS}, d AS (SELECT norm, min(id) AS id FROM forms GROUP BY norm),
    w AS (SELECT id, string_split(norm, ' ') AS w FROM d),
    g AS (SELECT DISTINCT id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM w)),
    n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
    p AS (SELECT a.id AS u, b.id AS v, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
    links AS (SELECT u, v, k / (x.n + y.n - k) AS similarity FROM p JOIN n x ON x.id = u JOIN n y ON y.id = v WHERE k / (x.n + y.n - k) >= {threshold})
    """


@query("near_links_half", f"WITH {links_sql(0.5)} SELECT u, v, round(similarity, 6) AS similarity FROM links")
def near_links_half(spark, sf_dir):
    return dedup.near_links(rows(spark, sf_dir), 5, 0.5).withColumn("similarity", F.round("similarity", 6))


@query("near_clusters", f"""WITH RECURSIVE {links_sql(0.8)},
    e AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
    reach(node, root) AS (SELECT id, id FROM d UNION SELECT e.v, reach.root FROM reach JOIN e ON e.u = reach.node),
    low AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
    SELECT f.id, low.root FROM forms f JOIN d USING (norm) JOIN low ON low.node = d.id""")  # fmt: skip
def near_clusters(spark, sf_dir):
    return dedup.near_clusters(rows(spark, sf_dir))


@query("cluster_representatives", f"""WITH {FORMS} SELECT norm_digest, id AS representative, source, members FROM (
    SELECT sha256(norm) AS norm_digest, id, source, count(*) OVER (PARTITION BY norm) AS members,
           row_number() OVER (PARTITION BY norm ORDER BY source <> 'src0', source <> 'src1', id) AS n FROM forms) WHERE n = 1""")  # fmt: skip
def cluster_representatives(spark, sf_dir):
    from quarry.functions.text import normal_lexical

    own = rows(spark, sf_dir).select("id", "source", F.sha2(normal_lexical(F.col("text")), 256).alias("norm_digest"))
    order = [F.col("source") != "src0", F.col("source") != "src1", F.col("id")]
    return dedup.representatives(own, "norm_digest", order).select("norm_digest", F.col("first.id").alias("representative"), F.col("first.source").alias("source"), "members")


@query("conflict_quarantine", f"""WITH {FORMS}, a AS (SELECT f.norm, f.id, l.quality AS answer FROM forms f LEFT JOIN labels l ON l.doc_id = f.id),
    r AS (SELECT norm, min(id) AS representative, count(*) AS members FROM a GROUP BY norm)
    SELECT sha256(norm) AS cluster, representative, members, NOT bool_and(coalesce(a.answer = first.answer, false) OR a.id = representative) AS conflict
    FROM a JOIN r USING (norm) JOIN (SELECT id, answer FROM a) first ON first.id = representative GROUP BY ALL""")  # fmt: skip
def conflict_quarantine(spark, sf_dir):
    from quarry.functions.text import normal_lexical

    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("answer"))
    own = rows(spark, sf_dir).select("id", F.sha2(normal_lexical(F.col("text")), 256).alias("cluster")).join(labels, "id", "left")
    return dedup.conflicts(own, "cluster", [F.col("id")], lambda a, b: a == b)


@query("greedy_solutions", """WITH RECURSIVE t AS (SELECT conv_id, turn, length(text) AS n, string_split_regex(trim(lower(text)), '\\s+') AS w FROM conversations WHERE role = 'assistant' AND text IS NOT NULL),
    o AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY n, turn) AS place,
        CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i+3], ' '))) END AS g FROM t),
    s(conv_id, place, chosen) AS (SELECT conv_id, place, [{'turn': turn, 'g': g}] FROM o WHERE place = 1
        UNION ALL SELECT o.conv_id, o.place, CASE WHEN len(list_filter(chosen, lambda x: len(list_intersect(x.g, o.g)) / len(list_distinct(list_concat(x.g, o.g))) >= 0.7)) > 0
            THEN chosen ELSE list_append(chosen, {'turn': o.turn, 'g': o.g}) END FROM s JOIN o ON o.conv_id = s.conv_id AND o.place = s.place + 1),
    f AS (SELECT conv_id, arg_max(chosen, place) AS chosen FROM s GROUP BY conv_id)
    SELECT conv_id AS problem, chosen[k].turn::BIGINT AS id, k::BIGINT AS place FROM (SELECT conv_id, chosen, unnest(generate_series(1, len(chosen))) AS k FROM f)""")  # fmt: skip
def greedy_solutions(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    return dedup.greedy_solutions(own.select("conv_id", F.col("turn").alias("id"), "text"), "conv_id")


@query("request_digests", "SELECT sha256(text) AS digest, min(conv_id * 1000 + turn) AS first_id, count(*) AS rows FROM conversations WHERE role = 'user' GROUP BY 1")
def request_digests(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return dedup.request_digests(own.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"))


@query("capped_solutions", """SELECT conv_id, turn FROM (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS many,
    row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) AS n FROM conversations WHERE role = 'assistant')
    WHERE n <= CASE WHEN many >= 3 THEN 1 ELSE 2 END""")  # fmt: skip
def capped_solutions(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    many = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("many"))
    return dedup.capped(own.join(many, "conv_id"), "conv_id", F.when(F.col("many") >= 3, 1).otherwise(2), [F.length("text"), F.col("turn")]).select("conv_id", "turn")

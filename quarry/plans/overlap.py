"""Decontamination queries: documents are the training rows, benchmark the evaluation items (four sets by item_id)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import overlap
from quarry.plans.registry import query
from quarry.session import table


def rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source", "lang")


def items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.concat(F.lit("set"), F.col("item_id") % 4).alias("eval_set"), "item_id", "text")


TOKENS = r"""list_filter(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '\$', '', 'g'), '\\(left|right|quad)([^a-z]|$)|\\[()\[\],;!]', '\2', 'g'), '([^\p{{L}}\p{{N}}_\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}])', ' \1 ', 'g'), '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+'), lambda t: regexp_matches(t, '[\p{{L}}\p{{N}}]'))"""


def grams_sql(n: int) -> str:
    return f"""
    docs AS (SELECT doc_id AS id, source, {TOKENS.format('text')} AS w FROM documents),
    own AS (SELECT 'set' || (item_id % 4) AS eval_set, item_id, {TOKENS.format('text')} AS w FROM benchmark),
    dg AS (SELECT DISTINCT id, array_to_string(w[i:i+{n - 1}], ' ') AS g FROM (SELECT id, w, unnest(generate_series(1, len(w) - {n - 1})) AS i FROM docs)),
    ig AS (SELECT DISTINCT eval_set, item_id, array_to_string(w[i:i+{n - 1}], ' ') AS g FROM (SELECT eval_set, item_id, w, unnest(generate_series(1, len(w) - {n - 1})) AS i FROM own)),
    total AS (SELECT eval_set, item_id, count(*) AS total FROM ig GROUP BY ALL),
    long AS (SELECT id, eval_set, item_id, count(*) AS matched, total, count(*) / total AS coverage, 'ngram_coverage' AS method
             FROM dg JOIN ig USING (g) JOIN total USING (eval_set, item_id) GROUP BY id, eval_set, item_id, total),
    short AS (SELECT id, eval_set, item_id, 0 AS matched, 0 AS total, 1.0 AS coverage, 'short_exact_substring' AS method
              FROM docs JOIN own ON len(own.w) < {n} AND contains(array_to_string(docs.w, ' '), array_to_string(own.w, ' '))),
    scored AS (SELECT id, eval_set, item_id, matched, total, coverage::DOUBLE AS coverage, method FROM long UNION ALL SELECT DISTINCT id, eval_set, item_id, matched, total, coverage::DOUBLE, method FROM short),
    top AS (SELECT id, max(coverage) AS best_coverage FROM scored GROUP BY id)
    """


def status_sql(threshold: float, near: float) -> str:
    return f"CASE WHEN best_coverage >= {threshold} THEN 'removed' WHEN best_coverage >= {near} THEN 'near_miss' ELSE 'kept' END"


@query("decontaminate_matches", f"WITH {grams_sql(8)} SELECT id, eval_set, item_id, round(coverage, 6) AS coverage, matched, total, method FROM scored")
def decontaminate_matches(spark, sf_dir):
    return overlap.matches(rows(spark, sf_dir), items(spark, sf_dir)).withColumn("coverage", F.round("coverage", 6))


@query("decontaminate_short_items", f"WITH {grams_sql(24)} SELECT id, eval_set, item_id, round(coverage, 6) AS coverage, matched, total, method FROM scored")
def decontaminate_short_items(spark, sf_dir):
    return overlap.matches(rows(spark, sf_dir), items(spark, sf_dir), 24).withColumn("coverage", F.round("coverage", 6))


@query("decontaminate_best_small_n", f"WITH {grams_sql(3)} SELECT id, eval_set, item_id, round(coverage, 6) AS coverage FROM scored QUALIFY row_number() OVER (PARTITION BY id ORDER BY coverage DESC, eval_set, item_id::VARCHAR) = 1")
def decontaminate_best_small_n(spark, sf_dir):
    return overlap.best(overlap.matches(rows(spark, sf_dir), items(spark, sf_dir), 3)).select("id", "eval_set", "item_id", F.round("coverage", 6).alias("coverage"))


@query("decontaminate_status", f"WITH {grams_sql(8)} SELECT source, {status_sql(0.7, 0.5)} AS status, count(*) AS n FROM docs LEFT JOIN top USING (id) GROUP BY ALL")
def decontaminate_status(spark, sf_dir):
    own = rows(spark, sf_dir)
    return overlap.status(own.select("id", "source"), overlap.matches(own, items(spark, sf_dir))).groupBy("source", "status").agg(F.count(F.lit(1)).alias("n"))


@query("decontaminate_near_band", f"WITH {grams_sql(3)} SELECT source, {status_sql(0.35, 0.15)} AS status, count(*) AS n FROM docs LEFT JOIN top USING (id) GROUP BY ALL")
def decontaminate_near_band(spark, sf_dir):
    own = rows(spark, sf_dir)
    scored = overlap.matches(own, items(spark, sf_dir), 3)
    return overlap.status(own.select("id", "source"), scored, 0.35, 0.15).groupBy("source", "status").agg(F.count(F.lit(1)).alias("n"))


@query("decontaminate_removals_by_set", f"WITH {grams_sql(8)} SELECT eval_set, count(DISTINCT CASE WHEN coverage >= 0.7 THEN id END) AS removed FROM (SELECT DISTINCT eval_set FROM own) LEFT JOIN scored USING (eval_set) GROUP BY eval_set")
def decontaminate_removals_by_set(spark, sf_dir):
    own = items(spark, sf_dir)
    return overlap.removal_counts(overlap.matches(rows(spark, sf_dir), own), own)


@query("decontaminate_kept", f"WITH {grams_sql(8)} SELECT id, sha256(text) AS digest FROM documents d JOIN docs ON d.doc_id = docs.id WHERE id NOT IN (SELECT id FROM scored WHERE coverage >= 0.7)")
def decontaminate_kept(spark, sf_dir):
    own = rows(spark, sf_dir)
    return overlap.kept(own, overlap.matches(own, items(spark, sf_dir))).select("id", F.sha2("text", 256).alias("digest"))


@query("decontaminate_lowest_removed", f"WITH {grams_sql(8)} SELECT id, round(best_coverage, 6) AS best_coverage FROM top WHERE best_coverage >= 0.7 ORDER BY best_coverage, id LIMIT 10")
def decontaminate_lowest_removed(spark, sf_dir):
    own = rows(spark, sf_dir)
    told = overlap.status(own.select("id"), overlap.matches(own, items(spark, sf_dir))).filter("status = 'removed'")
    return told.orderBy("best_coverage", "id").limit(10).select("id", F.round("best_coverage", 6).alias("best_coverage"))


#: The same over lexical forms (no LaTeX occurs in these tables), with number variants.
LEXICAL = r"""string_split(array_to_string(regexp_extract_all(regexp_replace(lower(coalesce({0}, '')), '\$', ' ', 'g'), '([\p{{L}}\p{{Nl}}\p{{No}}]+|\p{{Nd}}+)'), ' '), ' ')"""
TEMPLATE = r"list_transform({0}, lambda t: CASE WHEN regexp_full_match(t, '\p{{Nd}}+') THEN 'NUM' ELSE t END)"


@query("reference_matches", f"""WITH {grams_sql(8).replace(TOKENS.format("text"), LEXICAL.format("text"))},
    variants AS (SELECT DISTINCT id, eval_set, item_id, true AS number_variant FROM docs JOIN own ON {TEMPLATE.format("docs.w")} = {TEMPLATE.format("own.w")} AND docs.w <> own.w WHERE len(list_filter(own.w, lambda t: regexp_matches(t, '\\p{{Nd}}'))) > 0)
    SELECT coalesce(s.id, v.id) AS id, coalesce(s.eval_set, v.eval_set) AS eval_set, coalesce(s.item_id, v.item_id) AS item_id, round(coalesce(coverage, 0), 6) AS coverage, coalesce(number_variant, false) AS number_variant
    FROM scored s FULL JOIN variants v ON s.id = v.id AND s.eval_set = v.eval_set AND s.item_id = v.item_id""")  # fmt: skip
def reference_matches(spark, sf_dir):
    return overlap.reference_matches(rows(spark, sf_dir), items(spark, sf_dir)).withColumn("coverage", F.round("coverage", 6))

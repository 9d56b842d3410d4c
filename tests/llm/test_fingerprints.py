import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.llm import fingerprints as fp


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def paired(rows):
    """rows of distinct doc_ids: doc_id -> (text, edited, next text)."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0]))
    out = {}
    for n, (i, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        q = len(t) // 4
        out[i] = (t, t[: len(t) - q] + after[:q], after)
    return out


TEXTS = [None, "", "one", "a b c d", "A b c d e", "a b  c\td e\n", "😀é ß " * 9, " \n ", "x y z u v w " * 20, "0123"]


@pytest.mark.parametrize("buckets", [None, 4])
def test_rows(spark, buckets):
    rows = [(3 * i - 4, t) for i, t in enumerate(TEXTS)] + [(None, "null id with a few words in it")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, h int, bucket int")
    got = {r.doc_id: r for r in fp.fingerprinted(docs, buckets).collect()}
    want = paired(rows)
    assert got.keys() == want.keys()
    for i, (text, edited, after) in want.items():
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].near_edited == pytest.approx(alike(shingles(text), shingles(edited)))
        assert got[i].near_next == pytest.approx(alike(shingles(text), shingles(after)))
        assert len(got[i].sketch) == min(fp.K, len(shingles(text)))
    assert got[8].sketch == got[11].sketch


def test_estimates(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for i in range(12):
        r.shuffle(words)
        a = words[:2500]
        rows.append((i, " ".join(a), " ".join(a[200 * i % 2500 :] + words[2500:3000]), " ".join(a[:600])))
    frame = spark.createDataFrame(rows, "i long, a string, b string, c string").select("i", "a", "b", "c", *[fp.sketch(F.col(x)).alias("s" + x) for x in "abc"])
    s = {x: F.col("s" + x) for x in "abc"}
    out = frame.select(
        "a", "b", "c", fp.resemblance(s["a"], s["b"]).alias("ab"), fp.containment(s["c"], s["a"]).alias("ca"), fp.distinct_shingles(s["a"]).alias("na"),
        (fp.merged(s["a"], s["b"]) == fp.sketch(F.concat_ws(" ", "a", "b"))).alias("m"),
    ).collect()
    for row in out:
        assert abs(row.ab - alike(shingles(row.a), shingles(row.b))) < 0.2
        assert row.ca > 0.5 and abs(row.na - 2496) < 2496 * 0.35
    assert sum(abs(row.ab - alike(shingles(row.a), shingles(row.b))) for row in out) / len(out) < 0.06


def test_merge_all(spark):
    frame = spark.createDataFrame([(g, " ".join(f"w{n}" for n in range(g * 7, g * 7 + 50 * p + 9))) for g in range(2) for p in range(4)], "g int, t string")
    parts = frame.select("g", fp.sketch(F.col("t")).alias("s"))
    got = {r.g: r.s for r in fp.merge_all(parts, ["g"], "s").collect()}
    for g in range(2):
        want = sorted({h for r in parts.filter(f"g = {g}").collect() for h in r.s})[: fp.K]
        assert got[g] == want


def test_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h")] * 3 + [(2, "x" * 50_000)], "doc_id long, text string")
    rows = fp.fingerprinted(docs, 3).collect()
    assert sorted(r.doc_id for r in rows) == [1, 1, 1, 2] and all(r.edited_sha256 for r in rows)
    assert fp.fingerprinted(docs.limit(0)).count() == 0


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_hot_ids_are_cut_by_hash(spark, buckets):
    rows = [(i, f"text of {i} " * 9) for i in range(60)] + [(30, f"copy {i} of a hot id " * 5) for i in range(300)] + [(None, f"no id {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    hashed = sorted(((r.o, r.h, r.text) for r in docs.selectExpr("coalesce(doc_id, -9223372036854775807 - 1) AS o", "xxhash64(text) AS h", "text").collect()))
    want = sorted((hashed[n][2], hashed[(n + 1) % len(hashed)][2]) for n in range(len(hashed)))
    got = fp.with_next(docs, buckets).filter("copy = 0")
    assert sorted((r.text, r.next_text) for r in got.collect()) == want
    if buckets == 40:
        assert got.groupBy("bucket").count().agg({"count": "max"}).first()[0] < 100

import zlib

import numpy as np
import pytest

from quarry.llm import features, langid, quality


def test_word_hashes_depend_on_the_word_alone():
    a, b = features.word_hashes(b"one two  one\tthree"), features.word_hashes(b"  two one")
    assert len(a) == 4 and a[0] == a[2] and a[0] == b[1] and a[1] == b[0] and len({*a.tolist()}) == 3
    text = b"ab " * 1_000_000
    assert b"".join(features.chunks(text)) == text and max(map(len, features.chunks(text))) <= features.CHUNK
    assert sum(len(features.word_hashes(p)) for p in features.chunks(text)) == 1_000_000
    assert features.chunks(b"x" * (features.CHUNK + 5))[1] == b"xxxxx"


def test_gram_hashes():
    for n in (1, 2, 3):
        got = features.gram_hashes(b"abcabc", n)
        assert len(got) == 7 - n and got[0] == got[3 if n < 4 else 0] if n <= 3 and len(got) > 3 else True
    assert ((features.buckets(features.gram_hashes(b"abcdef" * 50, 3), 64)) < 64).all()


def test_machine_identity():
    """The sum-of-squares form is the pairwise sum."""
    r = np.random.default_rng(1)
    x, w, v = r.normal(size=(5, 7)), r.normal(size=7), r.normal(size=(7, 3))
    want = [0.3 + a @ w + sum(v[i] @ v[j] * a[i] * a[j] for i in range(7) for j in range(i + 1, 7)) for a in x]
    assert np.allclose(quality.Machine(0.3, w, v).raw(x), want)


def test_interactions_are_learned():
    r = np.random.default_rng(2)
    x = r.choice([0.0, 1.0], (800, 6))
    y = (x[:, 0] != x[:, 1]).astype(int)
    machine = quality.fit(x[:600], y[:600])
    assert ((machine.scores(x[600:]) >= 0.5) == y[600:]).mean() > 0.95


def test_constant_without_both_classes():
    for y in ([], [1, 1, 1], [0]):
        scores = quality.fit(np.ones((len(y), 4)), np.array(y, int)).scores(np.ones((3, 4)))
        assert len(set(scores.tolist())) == 1 and 0 < scores[0] < 1


@pytest.fixture(scope="module")
def tables(spark):
    sf = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_quality_held_out(tables):
    docs, labels = tables
    machine = quality.trained(docs, labels)
    rows = quality.scored(docs, machine).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 50 and np.mean([r.predicted == r.quality for r in held]) > 0.95


def test_quality_defined_cases(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame([(None, None, 1.0), (1, "", 1.0), (1, "", 1.0), (2, "a " * 200_000, 1.0), (3, "\U0001f600", 1.0)], "doc_id long, text string, score double")
    bad = spark.createDataFrame([(1, None), (2, 7), (None, 1), (99, 1)], "doc_id long, quality int")
    for machine in (quality.trained(odd, bad), quality.fit(np.random.default_rng(1).random((60, quality.WIDTH + quality.STATISTICS)), np.arange(60) % 2)):
        rows = quality.scored(odd, machine).collect()
        assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
        assert quality.kept(odd, machine).columns == odd.columns
    assert quality.scored(odd.limit(0), machine).count() == 0


def test_language_held_out(tables):
    docs, _ = tables
    rows = langid.identified(docs, langid.trained(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in rows if r.held_out]) > 0.95


def test_codewords():
    for n in (2, 3, 4, 7, 12, 40):
        code = langid.codewords(n)
        apart = (code.shape[1] - code @ code.T) / 2
        assert len(code) == n and apart[~np.eye(n, dtype=bool)].min() >= max(1, code.shape[1] // 5)


def test_one_wrong_bit_is_outvoted():
    code = langid.codewords(4)
    decoder = langid.Decoder(list("abcd"), code, np.eye(code.shape[1]) * 4, np.zeros(code.shape[1]))
    for k, word in enumerate(code):
        for bit in range(len(word)):
            x = word.copy()
            x[bit] *= -1
            assert decoder.shares(x[None])[0].argmax() == k


def test_language_defined_cases(spark):
    docs = spark.createDataFrame([(None, None, None, 1), (1, "", "en", 1), (2, "12 !?", "en", 1), (3, "so it is", "en", 1), (3, "so it is", "en", 1), (4, "é" * 300_000, None, 1)], "doc_id long, text string, lang string, score int")
    rows = sorted(langid.identified(docs, langid.trained(docs)).collect(), key=lambda r: (r.doc_id or 0, r.lang_pred))
    assert [r.lang_pred for r in rows] == ["und", "und", "und", "en", "en", "en"] and all(0 <= r.score <= 1 for r in rows)
    nothing = langid.trained(docs.limit(0))
    assert {r.lang_pred for r in langid.identified(docs, nothing).collect()} == {"und"}
    assert langid.identified(docs.limit(0), nothing).count() == 0


def test_rare_languages_keep_their_rows(spark, monkeypatch):
    """More languages than PER_LANGUAGE * MOST_ROWS has room for, of unequal size: each keeps its share of the bound."""
    monkeypatch.setattr(langid, "PER_LANGUAGE", 30)
    monkeypatch.setattr(langid, "MOST_ROWS", 400)
    sizes = {f"l{i:02d}": 1500 if i < 10 else 40 for i in range(20)}
    names = [n for n, size in sizes.items() for _ in range(size)]
    docs = spark.createDataFrame([(i, f"words of {n} {chr(97 + i % 26)}", n) for i, n in enumerate(names)], "doc_id long, text string, lang string")
    seen = {}
    monkeypatch.setattr(langid, "fit", lambda x, own: seen.update({n: own.count(n) for n in own}))
    langid.trained(docs)
    assert seen.keys() == sizes.keys() and min(seen.values()) >= 10 and max(seen.values()) <= 20

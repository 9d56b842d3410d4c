import numpy as np
import pytest

from quarry.llm import packing


@pytest.fixture(scope="module")
def path():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("byte_bpe_50k.json")


def encoded(path, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [0]


TEXTS = [None, "", " ", "a", "it's  two\n\nlines \t x² ½ 日本 <|endoftext|> 'LL 'll b", "Été straße ÿ×÷ 12345 !!?" * 30, "word " * 3000, "x" * 5000, "tie", "tie", "\x1c\x85​ a"]


def check(rows, docs, path, capacity=1024):
    """Every id lies in one piece, and sequences have no gaps; returns the padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in docs:
        ids = encoded(path, text)
        got = sorted(by_doc[doc_id], key=lambda r: r.start)
        assert all(r.doc_tokens == len(ids) for r in got)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in got]).tolist() == ids
        assert [r.start for r in got] == np.cumsum([0] + [r.length for r in got[:-1]]).tolist()
    padding = total = 0
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own[:-1]]).tolist()
        used = own[-1].offset + own[-1].length
        assert used <= capacity
        total += used
        padding += 0 if used & (used - 1) == 0 else capacity - used
    return padding, total


def test_texts(spark, path):
    docs = list(enumerate(TEXTS))
    frame = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, worker int").repartition(3)
    rows = packing.pack(frame, path).collect()
    check(rows, docs, path)


def test_table(spark, sf, path):
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    docs = [tuple(r) for r in frame.select("doc_id", "text").collect()]
    padding, total = check(packing.pack(frame.repartition(5), path).collect(), docs, path)
    assert padding < 0.02 * total


def test_empty(spark, path):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_piece_lengths():
    for n in (1, 31, 32, 33, 1023, 1024, 1025, 5000):
        got = packing.piece_lengths(n)
        assert sum(got) == n and max(got) <= 1024 and len(got) <= n // 1024 + 6

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import line_dedup as ld


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, e in enumerate(b, 1):
            new.append(min(row[j - 1] + (c != e), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def test_near_against_the_whole_table(spark):
    r = random.Random(1)
    rows = [("", ""), ("a", ""), ("", "b"), ("😀é", "😀e"), ("😀", "é😀"), ("ab" * 200, "ab" * 199 + "b")]
    for _ in range(400):
        a = "".join(r.choice("ab") for _ in range(r.randrange(9)))
        b = list(a)
        for _ in range(r.randrange(4)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randrange(2)] = [r.choice("ab")] * r.randrange(2)
        rows.append((a, "".join(b)))
    frame = spark.createDataFrame(rows, "a string, b string")
    for row in frame.select("a", "b", *[ld.near(F.col("a"), F.col("b"), k).alias(f"k{k}") for k in (1, 2, 3)]).collect():
        for k in (1, 2, 3):
            assert row[f"k{k}"] == (edits(row.a, row.b) <= k), row


def allowed(n, steps):
    return sum(n >= least for least in steps)


def is_near(a, b, points=(16,), words=(10,), short=20):
    """Few edits of code points (of lines up to so many words) or of words, as the shorter line allows."""
    for x, y, steps, most in ((a, b, points, short), (a.split(" "), b.split(" "), words, 10**9)):
        k = allowed(min(len(x), len(y)), steps) if max(len(z.split(" ")) for z in (a, b)) <= most else 0
        if k and abs(len(x) - len(y)) <= k and edits(x, y) <= k:
            return True
    return False


def brute(rows, **steps):
    """rows of distinct (doc_id, text): doc_id -> (n_lines, n_exact, n_near, text)."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    every = [(n, i, line) for n, (_, t) in enumerate(order) if t is not None for i, line in enumerate(t.split("\n")) if line.strip()]
    seen, gone = {}, {}
    for n, i, line in every:
        if line in seen:
            gone[n, i] = seen[line] or "exact"
            continue
        close = any(is_near(x, line, **steps) for x in seen)
        seen[line] = None
        if close:
            gone[n, i] = "near"
    out = {}
    for n, (doc_id, t) in enumerate(order):
        parts = [] if t is None else t.split("\n")
        kinds = [gone.get((n, i)) for i in range(len(parts))]
        left = t if not any(kinds) else "\n".join(p for p, k in zip(parts, kinds) if not k)
        out[doc_id] = (len(parts), kinds.count("exact"), kinds.count("near"), left)
    return out


def corpus(seed, n):
    r = random.Random(seed)
    base = ["".join(r.choice("abcde fgh") for _ in range(r.randrange(10, 60))) for _ in range(12)] + ["", "short", "ééé 😀 ünï cödé línes hère", "x" * 40, "x" * 41]
    rows = []
    for i in range(n):
        own = []
        for _ in range(r.randrange(6)):
            line = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                at = r.randrange(len(line) + 1)
                line[at : at + r.randrange(2)] = r.choice(["", "q", "é"])
            own.append("".join(line))
        rows.append((i * 3 - 5, "\n".join(own)))
    return rows + [(None, "a line of the document without an id\nx"), (1001, None), (1002, "")]


def of_words(seed, n):
    """Lines of words with some words changed, dropped, doubled or joined."""
    r = random.Random(seed)
    base = [[r.choice("a bb ccc dd e fff gg".split()) for _ in range(r.choice([6, 9, 10, 11, 19, 20, 21, 30, 39, 40, 41, 60]))] for _ in range(14)]
    rows = []
    for i in range(n):
        own = []
        for _ in range(r.randrange(5)):
            line = list(r.choice(base))
            for _ in range(r.choice([0, 1, 1, 2, 3, 4])):
                at = r.randrange(len(line) + 1)
                line[at : at + r.randrange(2)] = r.choice([[], ["q"], ["zz"], ["q", "e"]])
            own.append(" ".join(line))
        rows.append((i, "\n".join(own)))
    return rows


@pytest.mark.parametrize("group,make", [(48, corpus), (2, corpus), (2, of_words)])
def test_rows(spark, monkeypatch, group, make):
    monkeypatch.setattr(ld, "GROUP", group)
    monkeypatch.setattr(ld, "BROADCAST_ROWS", 0 if group == 2 else 1000)
    rows = make(group, 60)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n int")
    got = {r.doc_id: tuple(r)[1:] for r in ld.dedup_lines(docs).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("most", [0, 1000])
def test_the_optimizer_broadcasts_nothing(spark, monkeypatch, most):
    """File sizes say too little of the groups, so no join is left to them: only the counted keys may be broadcast."""
    plans = []

    def noted(df, *sort):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, *sort)

    cut = ld.cut
    monkeypatch.setattr(ld, "cut", noted)
    monkeypatch.setattr(ld, "GROUP", 2)
    monkeypatch.setattr(ld, "BROADCAST_ROWS", most)
    docs = spark.createDataFrame(corpus(2, 40), "doc_id long, text string")
    plans.append(ld.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString())
    assert sum("Join" in p for p in plans) > 8
    assert sum(p.count("BroadcastExchange") for p in plans) == (1 if most else 0)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_any_number_of_edits(spark, monkeypatch, k):
    """A measure of k edits of code points for all lines from 12 on, in groups that have to be divided, against all pairs."""
    monkeypatch.setattr(ld, "GROUP", 3)
    steps = (12,) * k
    rows = corpus(10 + k, 50)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    measure = ld.POINTS._replace(steps=steps, holds=lambda line: F.lit(True))
    gone = ld.dropped_lines(docs, (measure,))
    got = {r.o: (len(r.exact), len(r.near)) for r in gone.collect()}
    want = {i if i is not None else ld._LEAST: (e, n) for i, (_, e, n, _) in brute(rows, points=steps, words=(), short=10**9).items() if e or n}
    assert got == want


def test_edits_of_words(spark, monkeypatch):
    """One, two and three words from 10, 20 and 40 words on."""
    monkeypatch.setattr(ld, "GROUP", 3)
    rows = of_words(8, 50)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = ld.dropped_lines(docs, (ld.WORDS._replace(steps=(10, 20, 40)),))
    got = {r.o: (len(r.exact), len(r.near)) for r in gone.collect()}
    assert got == {i: (e, n) for i, (_, e, n, _) in brute(rows, points=(), words=(10, 20, 40)).items() if e or n}


def test_cleaned(spark):
    same = "this line is in both of the documents"
    rows = [(1, f"{same}\nand this one is of its own, only here", 9, "a"), (2, same, 9, "b"), (3, "", 0, "c"), (4, None, None, "d"), (5, "short\nshort", 11, "e"), (5, "short\nshort", 11, "e"), (6, f"{same}!\nrest", 9, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, first string").withColumnRenamed("first", "o.h")
    left = ld.cleaned(docs)
    assert left.columns == docs.columns
    assert sorted([tuple(r) for r in left.collect()]) == sorted([(1, rows[0][1], 9, "a"), (3, "", 0, "c"), (4, None, None, "d"), (5, "short", 5, "e"), (5, "short", 5, "e"), (6, "rest", 4, "f")])


def test_repeated_rows_and_empty(spark):
    line = "a line that is long enough to count here"
    docs = spark.createDataFrame([(1, line), (1, line), (2, line), (3, f"{line}\n{line}")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_exact, r.text) for r in ld.dedup_lines(docs).collect())
    assert got == [(1, 0, line), (1, 0, line), (2, 1, ""), (3, 2, "")]
    assert ld.dedup_lines(docs.limit(0)).count() == 0 and ld.cleaned(docs.limit(0)).count() == 0


def test_one_very_long_line(spark):
    words = ["w%d" % (i % 977) for i in range(60_000)]
    other = [*words[:30_000], "new", *words[30_001:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(other[:-4]))], "doc_id long, text string")
    assert {r.doc_id: r.n_near for r in ld.dedup_lines(docs).collect()} == {1: 0, 2: 1, 3: 0}


def test_long_lines_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(ld, "GROUP", 4)
    stem = "".join(random.Random(4).choice("abcdefgh ") for _ in range(900))
    rows = [(i, stem[:700] + f"word{i:04d}{'z' * (i % 3)}" + stem[700:]) for i in range(60)] + [(100 + i, stem + "q" * i) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_exact, r.n_near) for r in ld.dedup_lines(docs).collect()}
    texts = dict(rows)
    for i, (exact, near) in got.items():
        want = any(j < i and is_near(texts[j], texts[i]) for j in texts)
        assert (exact, near) == (0, int(want))
    assert list(itertools.islice(got, 1))


def test_query_drops_short_repeats(spark, tmp_path):
    """Short lines that are not blank go where an earlier one is equal; near ones and blank ones stay."""
    from quarry.llm.queries import QUERIES

    rows = [(1, "Les.\nRead more\n\n  \nLes."), (2, "Read more\nread more\n\n  \nx"), (3, "x\na line that is long enough to count"), (4, "a line that is long enough to count!\nLes")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op8_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {
        1: (5, 1, 0, "Les.\nRead more\n\n  "),
        2: (5, 1, 0, "read more\n\n  \nx"),
        3: (2, 1, 0, "a line that is long enough to count"),
        4: (2, 0, 1, "Les"),
    }

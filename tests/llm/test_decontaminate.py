import random
import re

import numpy as np

from quarry.llm import decontaminate as d


def least_edits(item, text):
    """Least edits of the item against any substring of the text, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, e in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != e), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(r, text, n):
    out = list(text)
    for _ in range(n):
        at = r.randrange(len(out))
        kind = r.randrange(3)
        if kind == 0:
            out[at] = r.choice("abcdefg")
        elif kind == 1:
            out.insert(at, r.choice("abc xyz"))
        elif len(out) > 1:
            del out[at]
    return "".join(out)


def words(r, n):
    return " ".join("".join(r.choice("abcdeilnorst") for _ in range(r.randrange(1, 8))) for _ in range(n))


def test_against_whole_tables():
    r = random.Random(5)
    items = [(i, words(r, r.choice([3, 10, 25, 40]))) for i in range(12)] + [(90, "Too sh"), (91, None), (92, "ÄÖ 日本語 テキスト です これ は 例 の 文")]
    items.append((93, items[3][1]))
    index = d.Index(items)
    texts = [None, "", "a", "日本 " * 40 + items[14][1]]
    for _ in range(160):
        own = r.choice(items[:12])[1]
        body = edited(r, own, r.randrange(0, 1 + int(0.16 * len(own))))
        texts.append(f"{words(r, r.randrange(12))}. {body.upper() if r.random() < 0.3 else body}\n{words(r, r.randrange(12))}")
    found = d.regions(index, texts)
    for text, own in zip(texts, found):
        low = d.normalised(text)
        got = {i: e for i, a, b, e in sorted(own, key=lambda x: -x[3])}
        for i, pattern in enumerate(index.texts):
            best = least_edits(pattern, low) if low else 10**6
            assert got.get(i) == (best if best <= index.k[i] else None), (pattern, low)
        for i, a, b, e in own:
            assert least_edits(index.texts[i], d.normalised(text[a:b])) <= index.k[i] + 2  # a space at either end is lost


def test_exact_region_in_source_places():
    item = "What is, then, the answer to question number 42 in the list of all questions?"
    text = f"Été -- intro!  {item.upper().replace(' ', '   ')} ... and out"
    ((i, a, b, e),) = d.regions(d.Index([(7, item)]), [text])[0]
    assert (i, e) == (0, 0) and re.sub(r"\W+", " ", text[a:b].lower()) == re.sub(r"\W+", " ", item.lower()).strip()


def test_windows(monkeypatch):
    r = random.Random(6)
    item = words(r, 30)
    texts = [words(r, n) + " " + edited(r, item, 6) + " " + words(r, 50) for n in range(0, 400, 3)]
    index = d.Index([(1, item)])
    whole = d.regions(index, texts)
    monkeypatch.setattr(d, "WINDOW", 300)
    assert d.regions(index, texts) == whole and all(whole)


def test_budget_leaves_a_gram():
    for m in range(d.Q, 2000):
        assert m + 1 - d.Q * (d.budget(m) + 1) >= 1


def test_frames(spark, sf):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    one = benchmark.orderBy("item_id").first()
    rows = [(1, None, 0), (2, "", 0), (3, f"x y z. {one.text}", 0), (3, f"x y z. {one.text}", 0), (4, "a clean text with nothing of it", 0), (None, one.text, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    found = d.find_leaks(docs, benchmark).collect()
    assert sorted((r.doc_id or 0, r.item_id) for r in found if r.item_id == one.item_id) == [(0, one.item_id), (3, one.item_id), (3, one.item_id)]
    left = d.clean(docs, benchmark)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 4]
    assert d.find_leaks(docs, benchmark.limit(0)).count() == 0 and d.find_leaks(docs.limit(0), benchmark).count() == 0


def test_parts(spark, monkeypatch):
    monkeypatch.setattr(d, "MOST_SHIPPED", 60)
    items = [(i, f"the number of this passage is written as {'abcdefgh'[i] * 9} here") for i in range(8)]
    docs = spark.createDataFrame([(i, t) for i, t in items], "doc_id long, text string")
    found = d.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in found if r.edits == 0) == [(i, i) for i in range(8)]


def test_alignment_drops_nothing():
    index = d.Index([(1, "abcdefghij" * 5)])
    text = d.codes("zz" + "abcdefghij" * 5)
    assert d.aligned(index, [(0, text, 2, 2), (0, text, 40, 45)]) == [(0, 2, 52), None]
    assert isinstance(np.uint32(3), np.uint32)


def test_parts_of_items(spark):
    r = random.Random(8)
    long, short = words(r, 400), words(r, 40)
    form = d.normalised(short)
    texts = {1: f"{words(r, 20)}. {short[: int(0.8 * len(short))]} {words(r, 30)}", 2: f"{words(r, 9)} {long[700:1030]}, {words(r, 9)}", 3: f"{words(r, 9)} {edited(r, long[300:600], 8)} {words(r, 9)}", 4: words(r, 300), 5: f"{words(r, 5)} {short}"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, short), (2, long)], "item_id long, text string")
    found = d.find_leaks(docs, benchmark).collect()
    assert sorted({(x.doc_id, x.item_id) for x in found}) == [(1, 1), (2, 2), (3, 2), (5, 1)]
    (cut,) = [x for x in found if x.doc_id == 2]
    assert cut.edits == 0 and len(set(range(cut.start, cut.end)) & set(range(texts[2].find(long[700:1030]), texts[2].find(long[700:1030]) + 330))) > 280
    assert [(x.edits, x.similarity) for x in found if x.doc_id == 5] == [(0, 1.0)] and len(form) > 100
    assert [x.doc_id for x in d.clean(docs, benchmark).collect()] == [4]


def test_a_text_that_repeats_itself_gives_no_band():
    """Few q-grams of an item, met again and again, are no sign of the item; the item itself still is one."""
    r = random.Random(11)
    item = "ab ab ab ab ab " + words(r, 22)
    index = d.Index([(1, item)])
    assert index.bands(d.codes("ab " * 400)) == []
    whole = "ab " * 100 + item + " ab" * 100
    assert index.bands(d.codes(whole)) and [(i, e) for i, _, _, e in d.regions(index, [whole])[0]] == [(0, 0)]

"""Benchmark decontamination by q-gram lemma filtering.

A benchmark item leaks where some region of a document is within an edit budget of it. The budget of an item of m characters
is ERROR_RATE * m edits, less for very short items so that the lemma below says something. Texts are compared as runs of
letters and digits in lower case joined by single spaces, so layout, case and punctuation cost nothing.

Lemma. A region within k edits of an item of m characters shares with it at least t = m + 1 - q(k + 1) q-grams whose
diagonals (place in the document less place in the item) span at most k. Diagonals are therefore counted in bands of
2(k + 1) that overlap by half: each alignment lies within one of them whole. Bands with t q-grams of the item or more, each
place of the item counted once, are retained, and verified by banded alignment: dynamic programming over the diagonals of the band only, all regions of a
batch side by side.

Parts. A document may hold only a part of an item. So items also enter the index as overlapping segments of SEGMENT
normalised characters (SHARE of a shorter item, but LEAST_SEGMENT at least), STRIDE apart, each an item of its own with its
own budget and bound. Any passage of an item that is STRIDE - 1 characters longer than a segment holds one whole. Segment
regions that overlap are one region; those that overlap a region of the whole item are left out.

Scale. One pass over the texts. The benchmark's q-grams travel with the tasks while they are few (MOST_SHIPPED characters,
checked); a larger benchmark is split into parts of that size and each part is one more pass. Texts are read in windows
that overlap by more than the longest region, so long texts need bounded memory and lose nothing. No pairs are formed
beyond the bands that hold enough q-grams.

Defined cases: null and empty texts leak nothing; items that are null or shorter than q characters when normalised are
left out, since the lemma has no q-gram to count; repeated items are found each under its own id, repeated rows of
documents each by itself; with an empty benchmark nothing is found; extra columns are not read, and clean() returns the
columns of documents as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import text_batches
from quarry.session import ship

Q, ERROR_RATE = 8, 0.1
#: Characters of a segment of an item, the share of a shorter item, the least, and how far apart segments begin.
SEGMENT, SHARE, LEAST_SEGMENT, STRIDE = 100, 0.7, 50, 20
#: Characters of benchmark items that one pass takes along.
MOST_SHIPPED = 4_000_000
#: Characters of documents that are looked at together: the arrays over them stay in a core's cache.
WINDOW = 250_000
_FILTER_BITS = 20

_RUN = re.compile(r"[^\W_]+")
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)
_BLANK = bytes(c if chr(c).isalnum() else 32 for c in range(256))


def normalised(text: str | None) -> str:
    """Runs of letters and digits in lower case, joined by single spaces."""
    low = (text or "").lower()
    try:
        return b" ".join(low.encode("latin-1").translate(_BLANK).split()).decode("latin-1")
    except UnicodeEncodeError:
        return " ".join(_RUN.findall(low))


def codes(text: str) -> np.ndarray:
    try:
        return np.frombuffer(text.encode("latin-1"), np.uint8).astype(np.uint32)
    except UnicodeEncodeError:
        return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4").astype(np.uint32)


def gram_hashes(array: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each run of Q = 8 codes, by doubling. Chance equals only add to a band's count."""
    if len(array) < Q:
        return np.zeros(0, np.uint32)
    h = array
    for step, multiplier in zip((1, 2, 4), _MULTIPLIERS):
        h = h[:-step] * multiplier + h[step:]
        h ^= h >> np.uint32(15)
    return h * _MULTIPLIERS[3]


def budget(m: int) -> int:
    """Edits allowed for an item of m characters: the rate, or what still leaves one q-gram to count."""
    return max(0, min(int(ERROR_RATE * m), m // Q - 1))


class Index:
    """q-grams of the items, by hash: a bit filter, the sorted hashes, and where each occurs."""

    def __init__(self, items: list[tuple[int, str]]):
        kept = [(i, n) for i, t in items if len(n := normalised(t)) >= Q]
        self.ids = [i for i, _ in kept]
        self.texts = [t for _, t in kept]
        self.codes = [codes(t) for _, t in kept]
        self.m = np.array([len(t) for _, t in kept], np.int64)
        self.k = np.array([budget(len(t)) for _, t in kept], np.int64)
        self.t = self.m + 1 - Q * (self.k + 1)
        hashes = [gram_hashes(c) for c in self.codes]
        every = np.concatenate([*hashes, np.zeros(0, np.uint32)])
        item = np.repeat(np.arange(len(kept)), [len(h) for h in hashes])
        place = np.concatenate([*(np.arange(len(h)) for h in hashes), np.zeros(0, np.int64)])
        order = np.argsort(every, kind="stable")
        self.hashes, self.first = np.unique(every[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(every)))
        self.item, self.place = item[order], place[order]
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.hashes >> np.uint32(32 - _FILTER_BITS)).astype(np.int64)] = True
        self.reach = int(max((self.m + 4 * (self.k + 1)).max(), Q) if len(kept) else Q)

    def _by_places(self, good: np.ndarray, keys: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Of the bands (key of their first cell) those in which enough q-grams of the item, each counted once, are found:
        a text that repeats itself meets the same few q-grams of an item again and again."""
        if not len(good):
            return good
        span, pairs = int(self.m.max()) + 1, []
        for step in (0, 1):  # a band is a cell and the next one
            at = np.searchsorted(good, keys - step).clip(max=len(good) - 1)
            own = good[at] == keys - step
            pairs.append(at[own] * span + places[own])
        found = np.bincount(np.unique(np.concatenate(pairs)) // span, minlength=len(good))
        return good[found >= self.t[good >> 40]]

    def bands(self, array: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first diagonal, last diagonal) of the bands that share enough q-grams with the item."""
        hashes = gram_hashes(array)
        at = np.flatnonzero(self.filter[(hashes >> np.uint32(32 - _FILTER_BITS)).astype(np.int64)])
        if not len(at) or not len(self.hashes):
            return []
        found = np.searchsorted(self.hashes, hashes[at]).clip(max=len(self.hashes) - 1)
        same = self.hashes[found] == hashes[at]
        at, found = at[same], found[same]
        counts = self.count[found]
        entry = np.repeat(self.first[found], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        item = self.item[entry]
        half = self.k[item] + 1
        diagonal = np.repeat(at, counts) - self.place[entry] + self.reach
        cell = diagonal // half
        keys = item * (1 << 40) + cell
        own, n = np.unique(keys, return_counts=True)
        items = own >> 40
        after = np.searchsorted(own, own + 1).clip(max=len(own) - 1)
        both = n + np.where(own[after] == own + 1, n[after], 0) * (after != np.arange(len(own)))
        good = own[both >= self.t[items]]
        lone = own[n >= self.t[items]]
        good = self._by_places(np.union1d(good, lone), keys, self.place[entry])
        out = []
        for key in good.tolist():
            i, c = key >> 40, key & (1 << 40) - 1
            h = int(self.k[i]) + 1
            out.append((i, c * h - self.reach, (c + 2) * h - 1 - self.reach))
        return out


def aligned(index: Index, tasks: list[tuple[int, np.ndarray, int, int]]) -> list[tuple[int, int, int] | None]:
    """For each (item, text, first diagonal, last diagonal): the least edits of the item against a region of the text whose
    alignment keeps to those diagonals, widened by the item's budget, as (edits, start, end); None beyond the budget.

    Dynamic programming over the band, one item character at a time, for all tasks side by side; a region's start and end
    are free. Cells outside the text cost more than the budget, and tasks beyond their budget everywhere are dropped."""
    out: list[tuple[int, int, int] | None] = [None] * len(tasks)
    own = np.array(sorted(range(len(tasks)), key=lambda n: -int(index.m[tasks[n][0]])), np.int64)
    items = np.array([tasks[n][0] for n in own], np.int64)
    m, big = index.m[items], (index.k[items] + 1)[:, None]
    low = np.array([tasks[n][2] for n in own]) - index.k[items]
    widths = np.array([tasks[n][3] for n in own]) + index.k[items] - low + 1
    sizes = np.array([len(tasks[n][1]) for n in own])
    width, longest = int(widths.max()), int(m.max())
    texts = np.zeros((len(own), width + longest), np.uint32)
    patterns = np.zeros((len(own), longest), np.uint32)
    for row, n in enumerate(own):
        i, text, _, _ = tasks[n]
        a = int(low[row])
        part = text[max(0, a) : max(0, a + width + longest)]
        texts[row, max(0, -a) : max(0, -a) + len(part)] = part[: width + longest - max(0, -a)]
        patterns[row, : index.m[i]] = index.codes[i]
    steps = np.arange(width)
    first, last = np.maximum(-low, 0)[:, None], (sizes - low)[:, None]
    band = steps[None, :] < widths[:, None]
    cost = np.where(band & (steps >= first) & (steps <= last), 0, big)
    start = np.broadcast_to(steps, cost.shape).copy()
    for i in range(longest):
        n = int((m > i).sum())
        if n == 0:
            break
        if n < len(own):
            own, items, m, big, low, texts, patterns, first, last, band, cost, start = (x[:n] for x in (own, items, m, big, low, texts, patterns, first, last, band, cost, start))
        diagonal = cost + (texts[:, i : i + width] != patterns[:, i : i + 1])
        down = np.concatenate((cost[:, 1:] + 1, big), axis=1)
        take = down < diagonal
        best = np.where(take, down, diagonal)
        origin = np.where(take, np.concatenate((start[:, 1:], start[:, :1]), axis=1), start)
        best = np.where(band & (steps + i + 1 >= first) & (steps + i + 1 <= last), best, big)
        slid = np.minimum.accumulate(best - steps, axis=1) + steps
        closer = slid < best
        if closer.any():
            origin = np.take_along_axis(origin, np.maximum.accumulate(np.where(closer, 0, steps), axis=1), axis=1)
            best = slid
        cost, start = np.minimum(best, big), origin
        for row in np.flatnonzero(m == i + 1):
            d = int(cost[row].argmin())
            if cost[row, d] < big[row, 0]:
                out[own[row]] = (int(cost[row, d]), int(low[row] + start[row, d]), int(low[row] + d + i + 1))
        if i % 8 == 7 and 2 * int((alive := cost.min(axis=1) < big[:, 0]).sum()) <= len(own):
            own, items, m, big, low, texts, patterns, first, last, band, cost, start = (x[alive] for x in (own, items, m, big, low, texts, patterns, first, last, band, cost, start))
    return out


def _places(text: str, low: str, wanted: list[int]) -> list[int]:
    """For places of the normalised text, in ascending order, the places in the text (of the gap's start for a space)."""
    out, at, last = [], 0, 0
    runs = _RUN.finditer(text)
    run = next(runs, None)
    for place in wanted:
        while run is not None and place > at + len(run[0]):
            at, last, run = at + len(run[0]) + 1, run.end(), next(runs, None)
        if run is None:  # only where lower case changes a text's length: then in proportion
            out.append(min(len(text), max(last, place * len(text) // max(1, len(low)))))
        else:
            out.append(run.start() + max(0, place - at))
    return out


#: Alignments that are computed side by side.
SIDE_BY_SIDE = 1000


def _verified(index: Index, texts: list, forms: list[str], bands: list[list]) -> list[list[tuple[int, int, int, int]]]:
    """For each text (place of the item in the index, start, end, edits) of the regions in retained bands that hold an item,
    in code points of the text; of overlapping regions of an item the closest, then the first."""
    hits: list[dict[tuple[int, int], tuple[int, int, int]]] = [{} for _ in texts]
    tasks, docs = [], []
    for doc, own in enumerate(bands):
        array = None
        for i, a, b in own:
            k, m = int(index.k[i]), len(index.texts[i])
            exact = forms[doc].find(index.texts[i], max(0, a - k), max(0, b + k + m))
            if exact >= 0:
                hits[doc][i, exact + m] = (0, exact, exact + m)
            else:
                array = codes(forms[doc]) if array is None else array
                tasks.append((i, array, a, b))
                docs.append(doc)
    for at in range(0, len(tasks), SIDE_BY_SIDE):
        some = tasks[at : at + SIDE_BY_SIDE]
        for (i, *_), doc, hit in zip(some, docs[at:], aligned(index, some)):
            if hit is not None and ((i, hit[2]) not in hits[doc] or hit < hits[doc][i, hit[2]]):
                hits[doc][i, hit[2]] = hit
    out = []
    for text, form, found in zip(texts, forms, hits):
        kept: list[tuple[int, int, int, int]] = []
        for (i, _), (edits, start, end) in sorted(found.items(), key=lambda x: (x[0][0], x[1])):
            if not any(j == i and start < b and a < end for j, a, b, _ in kept):
                kept.append((i, start, end, edits))
        wanted = sorted({p for _, a, b, _ in kept for p in (a, b - 1)})
        source = dict(zip(wanted, _places(text, form, wanted))) if kept else {}
        out.append(sorted((i, source[a], source[b - 1] + 1, e) for i, a, b, e in kept))
    return out


def regions(index: Index, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
    """For each text the regions that hold an item. Texts are filtered together, long ones in windows that overlap by more
    than the longest region; only retained bands are verified."""
    forms = [normalised(t) for t in texts]
    bands: list[list] = [[] for _ in texts]
    group: list[tuple[int, int, np.ndarray]] = []
    held = 0
    gap = np.zeros(index.reach + 1, np.uint32)

    def look() -> None:
        joined = np.concatenate([x for _, _, part in group for x in (part, gap)])
        starts = np.cumsum([0] + [len(part) + len(gap) for _, _, part in group])
        for i, a, b in index.bands(joined):
            reach = int(index.m[i] + index.k[i])
            first = np.searchsorted(starts, max(0, a - int(index.k[i])), "right") - 1
            last = np.searchsorted(starts, b + reach, "right") - 1
            for g in range(first, min(last, len(group) - 1) + 1):
                doc, at, _ = group[g]
                shift = at - int(starts[g])
                bands[doc].append((i, a + shift, b + shift))

    for doc, form in enumerate(forms if index.ids else []):
        array = codes(form)
        for at in range(0, len(array), WINDOW):
            if at and len(array) - at <= index.reach:
                break  # the window before holds it whole
            part = array[at : at + WINDOW + 2 * index.reach]
            if len(part) >= Q:
                group.append((doc, at, part))
                held += len(part) + len(gap)
                if held > WINDOW:
                    look()
                    group, held = [], 0
    if group:
        look()
    return _verified(index, texts, forms, bands)


def segments(text: str | None) -> list[str]:
    """The overlapping segments of an item's normalised text; none where a segment would be the whole item."""
    form = normalised(text)
    long = max(LEAST_SEGMENT, min(SEGMENT, int(SHARE * len(form))))
    if len(form) <= long:
        return []
    return [form[a : a + long] for a in [*range(0, len(form) - long, STRIDE), len(form) - long]]


class PartIndex(Index):
    """An index of the items and, after them, of their segments; owner is the place of the item that an entry is of."""

    def __init__(self, items: list[tuple[int, str]]):
        whole = [(i, t) for i, t in items if len(normalised(t)) >= Q]
        cuts = [(n, i, part) for n, (i, t) in enumerate(whole) for part in segments(t)]
        super().__init__(whole + [(i, part) for _, i, part in cuts])
        self.whole = len(whole)
        self.owner = [*range(len(whole)), *(n for n, _, _ in cuts)]


def passages(index: PartIndex, texts: list[str | None]) -> list[list[tuple[int, int, int, int, float]]]:
    """For each text (place of the item in the index, start, end, edits, similarity) of the regions that hold an item or a
    part of it. Where only segments are found, edits and similarity are those of the closest one."""
    out = []
    for own in regions(index, texts):
        found = [(i, a, b, e, 1 - e / int(index.m[i])) for i, a, b, e in own if i < index.whole]
        spans: dict[int, list[tuple[int, int]]] = {}
        for i, a, b, _, _ in found:
            spans.setdefault(i, []).append((a, b))
        runs: dict[int, list[tuple[int, int, int, float]]] = {}
        for i, a, b, e in sorted((r for r in own if r[0] >= index.whole), key=lambda r: r[1:]):
            item, close = index.owner[i], 1 - e / int(index.m[i])
            if any(a < y and x < b for x, y in spans.get(item, ())):
                continue
            before = runs.setdefault(item, [])
            if before and a < before[-1][1]:
                x, y, least, best = before[-1]
                before[-1] = (x, max(y, b), *min((least, best), (e, close), key=lambda p: -p[1]))
            else:
                before.append((a, b, e, close))
        out.append(sorted(found + [(i, *run) for i, own_runs in runs.items() for run in own_runs]))
    return out


def shipped_parts(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """The items in parts whose texts and segments hold at most MOST_SHIPPED characters, or one item each."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    size = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first().n * (1 + SEGMENT // STRIDE)
    parts = max(1, -(-int(size) // MOST_SHIPPED))
    if parts == 1:
        return [sorted((r.item_id, r.text) for r in rows.collect())]
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * parts)))
    return [sorted((r.item_id, r.text) for r in dealt.filter(F.col("part") == p).collect()) for p in range(2 * parts)]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per leaked region, of a whole item or a part of one: doc_id, item_id, start, end (code points of the text, end
    exclusive), edits, similarity."""

    def found(index: PartIndex):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, texts in text_batches(batches):
                rows = [(d, index.ids[i], a, b, e, close) for d, own in zip(ids, passages(index, texts)) for i, a, b, e, close in own]
                if rows:
                    kinds = [pa.int64()] * 5 + [pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "item_id", "start", "end", "edits", "similarity"])

        return run

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for part in shipped_parts(benchmark):
        one = texts.mapInArrow(found(PartIndex(part)), "doc_id long, item_id long, start long, end long, edits long, similarity double")
        out = one if out is None else out.unionByName(one)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no region of any item or part of one, with their own columns only."""

    def leaks(index: PartIndex):
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in parts:
                yield pd.Series([bool(own) for at in range(0, len(texts), 512) for own in regions(index, texts.iloc[at : at + 512].tolist())], dtype=bool)

        return F.pandas_udf(run, "boolean")

    for part in shipped_parts(benchmark):
        docs = docs.filter(~leaks(PartIndex(part))("text"))
    return docs


ship(__name__)

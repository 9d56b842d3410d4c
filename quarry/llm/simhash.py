"""SimHash near-duplicates by anchor-point covering.

Fingerprint: 64 bits over the XXH64 (seed 42) of a text's 4-word shingles, repeats included; a bit is 1 if it is set in
over half of them. Texts link at THRESHOLD = 4 or fewer differing bits; a component is what links reach.

Method. The 64 bits are split into three parts of 21, 21 and 22. Of two fingerprints that differ in at most 4 bits, one
part differs in at most 1. The anchors of a part are the words of a linear covering code of radius 1 (its parity checks
are four; the columns take on all 15 non-zero values), so a part's value is at most 1 away from some anchor, and a partner
at most 2: every fingerprint is copied to all anchors within 2 of each part (about 15 a part, by a table of the error
patterns of each syndrome), and within an anchor the whole fingerprints are compared. All links are found.

Scale. Equal fingerprints are collapsed before copying, so exact copies cost nothing. An anchor's task emits a star for
each component it sees, never pairs. Anchors that hold more than HOT fingerprints are dealt out anew by pairs of blocks of
the other bits: those differ in at most 4 bits, so of six blocks two are equal, and each of the 15 choices of two blocks
is a key. Large groups inside a task are divided in the same way. Links become components in operators.components.

Defined cases: null and empty texts and texts without words have fingerprint 0 and link like any other; rows with a null
doc_id take part, and their component_id is the smallest non-null doc_id reachable, or null; every row of the input gives
one row, repeated rows too; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import text_slices
from quarry.operators.components import connected_components
from quarry.session import cut, discard, ship

WORDS, SEED, THRESHOLD = 4, 42, 4
#: Words of a shingle where one_of_each() thins out a corpus.
STAGE_WORDS = 5
#: First bit and width of each part.
PARTS = ((0, 21), (21, 21), (42, 22))
#: Fingerprints at one anchor beyond which it is dealt out anew, and in a group of a task beyond which it is divided.
HOT, LARGE = 100_000, 4096
#: Shingles whose bits are counted at a time.
COUNTED = 200_000


def fingerprint(text: str | None, n: int = WORDS) -> int:
    """The 64-bit fingerprint of a text by its n-word shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    if len(words) <= n:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        starts = np.concatenate(([0], ends[:-n])).tolist()
        stops = (ends[n - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, stops)]
    counts = np.zeros(64, np.int64)
    array = np.array(hashes, "<u8")
    for at in range(0, len(array), COUNTED):
        counts += np.unpackbits(array[at : at + COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(array)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """(doc_id, fp, h) per row of docs: the fingerprint as a signed long, and the text's hash, which tells apart rows of
    one doc_id."""

    def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1):
                prints = np.array([fingerprint(t, n) for t in part.column(1).to_pylist()], "<u8").view("<i8")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints, pa.int64()), part.column(2)], names=["doc_id", "fp", "h"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long, h long")


def covering_patterns(width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """For a part: the parity column of each bit, and for each syndrome all error patterns of weight 0 to 2."""
    columns = np.array([1 + i % 15 for i in range(width)])
    patterns: list[list[int]] = [[] for _ in range(16)]
    patterns[0].append(0)
    for i in range(width):
        patterns[columns[i]].append(1 << i)
    for i, j in combinations(range(width), 2):
        patterns[columns[i] ^ columns[j]].append(1 << i | 1 << j)
    return columns, [np.array(p, np.int64) for p in patterns]


def _syndromes(values: np.ndarray, columns: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    for bit, column in enumerate(columns):
        out ^= (values >> bit & 1) * column
    return out


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For unsigned fingerprints: the index of a fingerprint and the key of an anchor that it is copied to, for all."""
    rows, keys = [], []
    for part, (first, width) in enumerate(PARTS):
        values = (prints >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.int64)
        columns, patterns = covering_patterns(width)
        syndromes = _syndromes(values, columns)
        for s in range(16):
            at = np.flatnonzero(syndromes == s)
            found = values[at, None] ^ patterns[s][None, :]
            rows.append(np.repeat(at, len(patterns[s])))
            keys.append((found + (part << 22)).ravel())
    return np.concatenate(rows), np.concatenate(keys)


def block_pair_keys(prints: np.ndarray, part: int) -> list[np.ndarray]:
    """The 15 keys made of two of six blocks of the bits outside a part."""
    first, width = PARTS[part]
    bits = [b for b in range(64) if not first <= b < first + width]
    cuts = np.linspace(0, len(bits), 7).astype(int)
    blocks = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        value = np.zeros(len(prints), np.int64)
        for n, bit in enumerate(bits[a:b]):
            value |= (prints >> np.uint64(bit) & np.uint64(1)).astype(np.int64) << n
        blocks.append(value)
    return [(i * 6 + j) << 32 | blocks[i] << 16 | blocks[j] for i, j in combinations(range(6), 2)]


def stars(prints: np.ndarray) -> tuple[list[int], list[int]]:
    """Links among distinct fingerprints that connect what is connected within THRESHOLD: each to the first it reaches."""
    rest, u, v = np.sort(prints), [], []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        frontier = [root]
        while frontier and len(rest):
            near = np.bitwise_count(rest ^ frontier.pop()) <= THRESHOLD
            if near.any():
                found = rest[near]
                rest = rest[~near]
                frontier.extend(found)
                u.extend(found.tolist())
                v.extend([int(root)] * len(found))
    return u, v


def group_links(prints: np.ndarray, part: int) -> tuple[list[int], list[int]]:
    """stars() for one anchor; a large group is divided by the blocks that two near fingerprints share."""
    if len(prints) <= LARGE:
        return stars(prints)
    u, v = [], []
    for keys in block_pair_keys(prints, part):
        order = np.argsort(keys, kind="stable")
        starts = np.flatnonzero(np.diff(keys[order], prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(order)]):
            if b - a > 1:
                x, y = stars(prints[order[a:b]])
                u += x
                v += y
    return u, v


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy().view("<u8")
        for at in range(0, len(prints), 5000):
            some = prints[at : at + 5000]
            rows, keys = anchors(some)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(some[rows].view("<i8"))], names=["anchor", "fp"])


def _divided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        anchor, prints = batch.column(0).to_numpy(), batch.column(1).to_numpy().view("<u8")
        for part in range(len(PARTS)):
            own = anchor >> 22 == part
            for keys in block_pair_keys(prints[own], part):
                mixed = (anchor[own] << 38) ^ keys
                yield pa.RecordBatch.from_arrays([pa.array(anchor[own]), pa.array(mixed), pa.array(prints[own].view("<i8"))], names=["anchor", "sub", "fp"])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from rows (anchor, sub, fp) that come sorted by anchor and sub."""

    def out(u: list[int], v: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.array(x, "<u8").view("<i8")) for x in (u, v)], names=["u", "v"])

    key, held, u, v = None, [], [], []
    for batch in batches:
        if not len(batch):
            continue
        anchor, sub, prints = (batch.column(i).to_numpy() for i in range(3))
        prints = prints.view("<u8")
        starts = np.flatnonzero((np.diff(anchor, prepend=anchor[0]) != 0) | (np.diff(sub, prepend=sub[0]) != 0))
        starts = [0, *starts.tolist(), len(anchor)]
        for a, b in zip(starts[:-1], starts[1:]):
            own = (int(anchor[a]), int(sub[a]))
            if own != key:
                if sum(map(len, held)) > 1:
                    x, y = group_links(np.concatenate(held), key[0] >> 22)
                    u += x
                    v += y
                key, held = own, []
            held.append(prints[a:b])
        if len(u) > 100_000:
            yield out(u, v)
            u, v = [], []
    if sum(map(len, held)) > 1:
        x, y = group_links(np.concatenate(held), key[0] >> 22)
        u += x
        v += y
    yield out(u, v)


def links(distinct_prints: DataFrame) -> DataFrame:
    """Links (u, v) among a column fp of distinct fingerprints that connect all that near pairs connect."""
    copies = distinct_prints.select("fp").mapInArrow(_copies, "anchor long, fp long")
    hot = cut(copies.groupBy("anchor").count().filter(F.col("count") > HOT).select("anchor"))
    plain = copies
    if hot.count():
        plain = copies.join(hot, "anchor", "left_anti")
        divided = copies.join(hot, "anchor", "left_semi").select("anchor", "fp").mapInArrow(_divided, "anchor long, sub long, fp long")
    dealt = plain.select("anchor", F.lit(0).cast("long").alias("sub"), "fp")
    if plain is not copies:
        dealt = dealt.unionByName(divided)
    dealt = dealt.repartition("anchor", "sub").sortWithinPartitions("anchor", "sub")
    return dealt.mapInArrow(_links, "u long, v long")


def _rooted(prints: DataFrame, first) -> DataFrame:
    """(fp, root, first) per distinct fingerprint: its component, and an aggregate of its rows."""
    distinct = cut(prints.groupBy("fp").agg(first.alias("first")))
    found = connected_components(links(distinct))
    return distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits), component_id."""
    prints = cut(fingerprints(docs).drop("h"))
    roots = cut(_rooted(prints, F.min("doc_id")))
    smallest = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = cut(roots.join(smallest, "root").select("fp", "component_id"))
    discard(roots)
    return prints.join(labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, in its own columns: that of the smallest doc_id (null ones come last), then of
    the smallest hash of the text; of equal rows one. Shingles have STAGE_WORDS words here, as near-duplicate stages do."""
    prints = cut(fingerprints(docs, STAGE_WORDS))
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.col("h"))
    chosen = cut(_rooted(prints, F.min(rank)).groupBy("root").agg(F.min("first").alias("first")).select("first.*"))
    discard(prints)
    names = [F.col(f"`{c}`") for c in docs.columns]
    own = docs.select(
        F.struct(*names).alias("row"), F.col("doc_id").isNull().alias("unnamed"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id"), F.xxhash64("text").alias("h")
    )
    return own.join(chosen, ["unnamed", "id", "h"], "left_semi").dropDuplicates(["unnamed", "id", "h"]).select("row.*")

ship(__name__)

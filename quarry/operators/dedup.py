"""Exact and near duplicates, representatives, answer conflicts, and greedy deduplication of solutions.

Near duplicates: rows whose distinct word n-gram sets have a Jaccard similarity at or above the threshold link, and
components of links are clusters. Equal normal forms are collapsed first, and n-grams are 64-bit hashes of hashed words.
Of two sets that reach the threshold t, each has one of its first n - ceil(t n) + 1 n-grams in common with the other's
(the prefix filter, under one global order by frequency, so that frequent ones are keys only of sets that hold little else,
and n-grams of one set alone, which come first, are only counted). At the first shared one, what can follow must be enough
for t (the positional filter, which implies that lengths agree). Near copies meet at most of their keys, so sets are put in
blocks of likely copies, a set is a candidate of a block once instead of its members many times, and it goes there once; each
pair of them is then verified on all n-grams that it shares, so every link is found and none is estimated.

Null texts count as empty; repeated rows are each other's duplicates; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.functions import text as T
from quarry.operators.components import connected_components
from quarry.session import cut, default_parallelism, discard, release, ship

#: N-grams that are shuffled together, about 14 bytes each; it bounds disk and changes no result.
SLICE = 64_000_000
#: Repeated rows that are broadcast, 8 bytes each; beyond that they go through a shuffle.
FEW = 500_000
#: Sets of a block, a power of two.
BLOCK = 256
#: N-grams of sets that are compared with a block at a time (one set at least).
CHUNK = 200_000
#: N-grams that so many sets of a block hold are counted by matrix products, WIDE of them at a time.
DENSE, WIDE = 16, 4096
#: A count of sets that tests go beyond.
COMMON = 16
#: What rounding may add to a bound.
SLACK = 1e-9


def exact_clusters(rows: DataFrame, normal=T.normal_lexical) -> DataFrame:
    """id, root (the smallest id of an equal normal form), members. rows: id, text.

    The normal form's digest is grouped with partial aggregates, and the counts joined back (adaptive execution splits a
    digest that many rows share)."""
    own = rows.select("id", F.sha2(normal(F.coalesce("text", F.lit(""))), 256).alias("digest"))
    counted = own.groupBy("digest").agg(F.min("id").alias("root"), F.count(F.lit(1)).alias("members"))
    return own.join(counted, "digest").select("id", "root", "members")


def _forms(rows: DataFrame, n: int, normal) -> DataFrame:
    """(id, digest, grams) of each row: its normal form's digest and n-gram hashes."""
    own = rows.select("id", normal(F.coalesce("text", F.lit(""))).alias("normal"))
    return own.select("id", F.sha2("normal", 256).alias("digest"), T.shingle_hashes(F.col("normal"), n).alias("grams"))


def _numbered(forms: DataFrame) -> DataFrame:
    return cut(forms.withColumn("row", F.monotonically_increasing_id()))


def _distinct(own: DataFrame) -> DataFrame:
    """(id, size, grams) of the first row of each digest in what _numbered() wrote; only the rows that are not it move."""
    rows = own.select("digest", "id", "row")
    first = rows.groupBy("digest").agg(F.min(F.struct("id", "row")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", F.col("first.row").alias("first"))
    later = cut(rows.join(first, "digest").filter("row <> first").select("row"))
    few = later.count() <= FEW
    sets = own.join(F.broadcast(later) if few else later.hint("merge"), "row", "left_anti").select("id", F.size("grams").alias("size"), "grams")
    return sets if few else cut(sets)


def _most_alone(threshold: float) -> Column:
    """How many n-grams a set with links can have alone."""
    return F.col("size") - F.ceil(F.lit(threshold) * F.col("size") - SLACK).cast("int")


def _shared(sets: DataFrame, low: int, high: int) -> list[DataFrame]:
    """(id, size, often, gram) of the n-grams from low to below high that several sets have, in tables of cut().

    They go through one shuffle, in which they are counted; that is done for about SLICE of them at a time, each a range of
    hashes, and what a slice shuffled is given back before the next, so disk does not grow with it."""
    total = (sets.agg(F.sum("size")).first()[0] or 0) * (high - low) / 2**64
    slices = max(1, math.ceil(total / SLICE))
    bounds = [low + (high - low) * k // slices for k in range(slices + 1)]
    parts = []
    for one, after in zip(bounds, bounds[1:], strict=False):
        each = sets.select("id", "size", F.explode("grams").alias("gram"))
        if after - one < 2**64:
            each = each.filter(F.col("gram").between(one, after - 1))
        counted = each.withColumn("often", F.count(F.lit(1)).over(Window.partitionBy("gram")))
        parts.append(cut(counted.filter("often > 1").select("id", "size", "often", "gram")))
        release(sets.sparkSession)
    return parts


def _hopeful(sets: DataFrame, parts: list[DataFrame], below: int, threshold: float) -> DataFrame:
    """The sets that can still have links, as a table of cut(), once parts holds all that is shared below a hash: the others
    have more n-grams alone there than a set with links has altogether."""
    shared = reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.count(F.lit(1)).alias("shared"))
    seen = sets.select("id", "size", F.size(F.filter("grams", lambda g: g < F.lit(below))).alias("seen"))
    stay = cut(seen.join(shared, "id", "left").filter(F.col("seen") - F.coalesce("shared", F.lit(0)) <= _most_alone(threshold)).select("id"))
    chosen = F.broadcast(stay) if stay.count() <= FEW else stay.hint("merge")
    out = cut(sets.join(chosen, "id", "left_semi"))
    discard(stay)
    return out


def _held(sets: DataFrame, threshold: float | None = None) -> DataFrame:
    """(id, size, held): of each set that has n-grams in common with others, those n-grams, rare ones first.

    With a threshold, sets that can have no links may be left out, and do not count for others; most are known once a
    little more than 1 - threshold of the hashes have been looked at, so the rest is looked up for few sets."""
    low, high = -(2**63), 2**63
    middle = high if threshold is None else min(high, low + int(2**64 * (1 - threshold) * 1.3))
    parts = _shared(sets, low, middle)
    if middle < high:
        rest = _hopeful(sets, parts, middle, threshold)
        parts += _shared(rest, middle, high)
    held = F.transform(F.sort_array(F.collect_list(F.struct("often", "gram"))), lambda x: x["gram"])
    own = reduce(DataFrame.unionByName, parts).groupBy("id", "size").agg(held.alias("held"))
    out = cut(own if threshold is None else own.filter(F.col("size") - F.size("held") <= _most_alone(threshold)))
    discard(*parts, *([rest] if middle < high else []))
    release(sets.sparkSession)
    return out


def _prefix(threshold: float) -> tuple[Column, Column]:
    """How many n-grams a set of _held() has alone, and the shared ones among its first ones."""
    keep = _most_alone(threshold) + 1
    alone = F.col("size") - F.size("held")
    return alone, F.slice("held", 1, F.greatest(F.least(keep - alone, F.size("held")), F.lit(0)))


def _prefixes(held: DataFrame, threshold: float, *more: str) -> DataFrame:
    """(gram, id, size, at) of the shared n-grams among the first ones of each set. What a set alone has comes first in the
    order and is counted by number, since it is no key; most sets of an ordinary corpus have no key at all."""
    alone, prefix = _prefix(threshold)
    return held.select("id", "size", *more, alone.alias("alone"), F.posexplode(prefix).alias("at", "gram")).select("gram", "id", "size", (F.col("alone") + F.col("at")).alias("at"), *more)


def _blocks(held: DataFrame, threshold: float) -> DataFrame:
    """(id, size, held, block) of the sets that have keys, up to BLOCK in a block. Sets are ordered by the least hash among
    their keys, which near copies often have in common; any other order would give the same links."""
    least = held.withColumn("least", F.array_min(_prefix(threshold)[1])).filter("least IS NOT NULL")
    near = least.repartitionByRange("least", "id").sortWithinPartitions("least", "id").drop("least")
    return cut(near.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK.bit_length() - 1)))


def _guests(blocks: DataFrame, threshold: float) -> DataFrame:
    """(id, block): sets that may link to one of a later block."""
    keys = cut(_prefixes(blocks, threshold, "block"))
    share = F.lit(threshold / (1 + threshold))
    # at the first n-gram that sets of sizes n and m share, at places i and j, what can follow is n - i and m - j, and each
    # must be share * (n + m) at least; of a block, the smallest m and the largest rest count
    hosts = keys.groupBy("gram", F.col("block").alias("host")).agg(F.min("size").alias("least"), F.max(F.col("size") - F.col("at") - share * F.col("size")).alias("rest"))
    enough = (F.col("size") - F.col("at") - share * F.col("size") >= share * F.col("least") - SLACK) & (F.col("rest") >= share * F.col("size") - SLACK)
    out = cut(keys.join(hosts, "gram").filter((F.col("block") < F.col("host")) & enough).select("id", F.col("host").alias("block")).distinct())
    discard(keys)
    release(blocks.sparkSession)
    return out


class _Block:
    """Sets of n-grams, looked up by n-gram."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, grams: np.ndarray):
        self.ids, self.sizes = ids, sizes
        order = np.argsort(grams, kind="stable")
        self.holders = np.repeat(np.arange(len(ids)), lengths)[order]
        self.grams, self.starts, self.often = np.unique(grams[order], return_index=True, return_counts=True)
        dense = self.often >= DENSE
        self.column = np.where(dense, np.cumsum(dense) - 1, -1)
        self.columns = int(dense.sum())
        self.own = np.repeat(self.column, self.often)

    def shared(self, lengths: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """How many n-grams each of the given sets (rows) has in common with each of the block (columns)."""
        n, width = len(lengths), len(self.ids)
        of = np.repeat(np.arange(n), lengths)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        hit = self.grams[at] == grams
        at, of = at[hit], of[hit]
        column = self.column[at]
        thin = column < 0
        times, first = self.often[at[thin]], self.starts[at[thin]]
        places = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
        out = np.bincount(np.repeat(of[thin], times) * width + self.holders[places], minlength=n * width).reshape(n, width)
        for low in range(0, self.columns, WIDE):
            a, b = np.zeros((n, WIDE), np.float32), np.zeros((width, WIDE), np.float32)
            here = (column >= low) & (column < low + WIDE)
            a[of[here], column[here] - low] = 1
            here = (self.own >= low) & (self.own < low + WIDE)
            b[self.holders[here], self.own[here] - low] = 1
            out += (a @ b.T).astype(np.int64)
        return out


def _verified(threshold: float, kind: pa.DataType):
    """For mapInArrow: links (u, v, similarity) in each block and of its guests, from rows ordered by block, its own first."""
    schema = pa.schema([("u", kind), ("v", kind), ("similarity", pa.float64())])

    def compared(block: _Block, inside: bool, ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, grams: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum(lengths)
        low = 0
        while low < len(ids):
            before = ends[low] - lengths[low]
            high = min(max(low + 1, int(np.searchsorted(ends, before + CHUNK, "right"))), low + BLOCK)
            both = block.shared(lengths[low:high], grams[before : ends[high - 1]])
            similarity = both / (sizes[low:high, None] + block.sizes[None, :] - both)
            wanted = ids[low:high, None] < block.ids[None, :] if inside else ids[low:high, None] != block.ids[None, :]
            i, j = np.nonzero((similarity >= threshold) & wanted)
            if len(i):
                a, b = ids[low:high][i], block.ids[j]
                yield pa.record_batch([pa.array(np.minimum(a, b), kind), pa.array(np.maximum(a, b), kind), pa.array(similarity[i, j])], schema=schema)
            low = high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, members, now = None, [], None
        for batch in batches:
            names, guest, ids, sizes = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "guest", "id", "size"))
            held = batch.column("held")
            lengths, grams = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), held.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            edges = [0, *(np.nonzero((names[1:] != names[:-1]) | (guest[1:] != guest[:-1]))[0] + 1), len(names)]
            for low, high in zip(edges, edges[1:], strict=False):
                if low == high:
                    continue
                part = ids[low:high], sizes[low:high].astype(np.int64), lengths[low:high], grams[ends[low] : ends[high]]
                if members and (guest[low] or names[low] != now):
                    whole = [np.concatenate(x) for x in zip(*members, strict=True)]
                    block, members = _Block(*whole), []
                    yield from compared(block, True, *whole)
                now = names[low]
                if guest[low]:
                    yield from compared(block, False, *part)
                else:
                    members.append(part)
        if members:
            whole = [np.concatenate(x) for x in zip(*members, strict=True)]
            yield from compared(_Block(*whole), True, *whole)

    return run


def _links(forms: DataFrame, threshold: float) -> DataFrame:
    """(u, v, similarity) for the distinct forms of _forms(), which may have gone through _numbered()."""
    own = forms if "row" in forms.columns else _numbered(forms)
    sets = _distinct(own)
    held = _held(sets, threshold)
    discard(sets)
    if own is not forms:
        discard(own)
    blocks = _blocks(held, threshold)
    discard(held)
    guests = _guests(blocks, threshold)
    each = ["block", "guest", "id", "size", "held"]
    hosts = blocks.withColumn("guest", F.lit(False)).select(each)
    both = hosts.unionByName(guests.join(blocks.drop("block"), "id").withColumn("guest", F.lit(True)).select(each))
    kind = blocks.schema["id"].dataType
    dealt = both.repartition(default_parallelism(blocks.sparkSession), "block").sortWithinPartitions("block", "guest")
    return dealt.mapInArrow(_verified(threshold, to_arrow_type(kind)), f"u {kind.simpleString()}, v {kind.simpleString()}, similarity double")


def near_links(rows: DataFrame, n: int = 5, threshold: float = 0.8, normal=T.normal_lexical) -> DataFrame:
    """(u, v, similarity) for u < v: links between distinct normal forms, each under its smallest id."""
    return _links(_forms(rows, n, normal), threshold)


def near_clusters(rows: DataFrame, n: int = 5, threshold: float = 0.8, normal=T.normal_lexical) -> DataFrame:
    """id, root: every row with the smallest id of its cluster, exact duplicates included."""
    forms = _numbered(_forms(rows, n, normal))
    firsts = forms.groupBy("digest").agg(F.min("id").alias("node"))
    linked = connected_components(_links(forms, threshold))
    return forms.select("id", "digest").join(firsts, "digest").join(linked, "node", "left").select("id", F.coalesce("component", "node").alias("root"))


def representatives(members: DataFrame, cluster: str, order: list[Column]) -> DataFrame:
    """The first row of each cluster by the given order, as a struct aggregate (no window, so no cluster is gathered)."""
    rank = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)])
    return members.groupBy(cluster).agg(F.min_by(F.struct("*"), rank).alias("first"), F.count(F.lit(1)).alias("members"))


def conflicts(members: DataFrame, cluster: str, order: list[Column], same) -> DataFrame:
    """Clusters with conflict (some member's answer is not equivalent to the representative's) and members. same: a
    function of two answer columns. A null answer is equivalent to nothing but makes no conflict in a cluster of one."""
    first = representatives(members, cluster, order).select(cluster, F.col("first.id").alias("representative"), F.col("first.answer").alias("_first"), "members")
    told = members.join(first, cluster).withColumn("_same", F.coalesce(same(F.col("answer"), F.col("_first")), F.lit(False)) | (F.col("id") == F.col("representative")))
    return told.groupBy(cluster, "representative", "members").agg((~F.every("_same")).alias("conflict"))


def _gram_set(text: str, n: int) -> set[tuple[str, ...]]:
    words = text.lower().split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or {tuple(words)}


def greedy_solutions(rows: DataFrame, problem: str, n: int = 4, threshold: float = 0.7) -> DataFrame:
    """Solutions of a problem that stay: from the shortest on, one goes if it is too similar to one that stays.

    rows: problem, id, text. The order of decisions matters, so a problem's solutions are looked at together; of equal texts
    only the first comes there, since the others go in any case, and a solution is compared with those that share an n-gram
    with it. Ties in length go by id. Null texts go."""
    if not 0 < threshold <= 1:
        raise ValueError("need 0 < threshold <= 1")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        sizes, holders, out = [], {}, []
        for row in sorted(frame.itertuples(index=False), key=lambda r: (len(r.text), r.id)):
            own = _gram_set(row.text, n)
            shared = Counter(k for g in own for k in holders.get(g, ()))
            if any(m / (len(own) + sizes[k] - m) >= threshold for k, m in shared.items()):
                continue
            for g in own:
                holders.setdefault(g, []).append(len(sizes))
            sizes.append(len(own))
            out.append((row.problem, row.id, len(out) + 1))
        return pd.DataFrame(out, columns=["problem", "id", "place"])

    own = rows.select(F.col(problem).cast("long").alias("problem"), F.col("id").cast("long").alias("id"), "text").filter("text IS NOT NULL")
    first = own.groupBy("problem", F.sha2("text", 256).alias("digest")).agg(F.min(F.struct("id", "text")).alias("s")).select("problem", "s.*")
    return first.groupBy("problem").applyInPandas(one, "problem long, id long, place long")


def request_digests(rows: DataFrame) -> DataFrame:
    """Distinct requests: digest of the text, how many rows ask it, and the first of them."""
    return rows.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("rows"))


def capped(rows: DataFrame, problem: str, cap: Column, order: list[Column]) -> DataFrame:
    """At most cap solutions of each problem in the given order."""
    window = Window.partitionBy(problem).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= cap).drop("_n")


ship(__name__)

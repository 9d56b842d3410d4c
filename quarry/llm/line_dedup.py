"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

A line (text between line feeds) that is not blank goes if an earlier one, by (doc_id, line number), is equal to it or near
it. "Earlier" looks at all lines, kept or not, so the result does not depend on an order of work. Near means few edits
(insertions, deletions, substitutions) in units of a kind: one code point for lines of 16 code points to SHORT words, and one
word for lines of 10 words and more (words stand between single blanks). The shorter line decides how many edits a pair may
have. Each Measure has such a threshold for each length; the join works for any number of edits.

Method. A line of n units that may have k edits is split into k + 1 segments, each an index entry under its content, its
number and n. One of them is whole in every line within k edits, with at most j edits before the j-th segment and k - j
after it; so a line probes, for its own length and each of the k lengths below (the length-aware part), the substrings at
the few places where that can be. Lines that meet under a key are verified by the banded bit-parallel edit distance.

Groups. Only keys that two different lines share are looked at further. In a group of more than GROUP lines, all are
compared with the earliest one; where some are left that are not near it, the group is divided: the longest part beside
the shared segments has j of the edits left, so its own j + 1 segments become part of the key, with the lengths and places
as before (for one edit, all but one of DIVISION segments). That goes on until groups are small or their parts are no longer than the edits left. What then is still in a
large group is compared in blocks of about GROUP lines. A row stands for a line and a block, never for a pair, no list
grows beyond a group's bound, and every near pair is looked at.

Scale. Three passes over the texts: identities of lines; keys, of which only those that two lines share are kept (24 bytes
a key go through the shuffle, no text); and the lines under shared keys, which are joined to the shared keys (broadcast only
below BROADCAST_ROWS keys of 8 bytes, counted first). The texts themselves are shuffled once, to take lines out. Each
level is cut as a table in the shared scratch folder. All other joins are hinted to be sort-merge joins: the optimizer goes by
the size of files, where rows of one group compress a hundredfold, and knows nothing of what an explode adds, so it would
broadcast levels that don't fit the driver.

Hashes: a line's identity is two 64-bit hashes with the length; a key is a 64-bit hash, and what it brings together is
verified, so a clash of keys costs time and no wrong result.

Defined cases: null and empty texts have no lines to drop; blank lines (white space only) stay; rows of one doc_id are told
apart by their text's hash, and of equal rows with one doc_id all lines count as the same places (they stay or go together,
and do not drop each other); null doc_ids come first; an empty table gives no rows; columns of documents other than text
and n_chars stay as they are, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bound
from quarry.session import cut, discard


class Measure(NamedTuple):
    """A kind of unit: how a line's value is made, measured and cut (cut: SQL function of value, place and length), how it is
    split into units for verification, from which numbers of units on 1, 2, ... edits are allowed, and which lines are
    measured so. Steps must exceed their edits, so that no segment is empty."""

    name: str
    value: Callable[[Column], Column]
    size: Callable[[Column], Column]
    cut: str
    units: Callable[[Column], Column]
    steps: tuple[int, ...]
    holds: Callable[[Column], Column] = lambda line: F.lit(True)

    def allowed(self, n: Column) -> Column:
        """Edits that a line of so many units may have."""
        return sum((F.when(n >= least, 1).otherwise(0) for least in self.steps), F.lit(0))


def _points(line: Column) -> Column:
    return F.filter(F.split(line, ""), lambda c: c != "")


def _words(line: Column) -> Column:
    """Words as 64-bit hashes: slices of them are copied and hashed without an object for each word."""
    return F.transform(F.split(line, " "), lambda w: F.xxhash64(w))


WORDS = Measure("words", _words, F.size, "slice", _words, (10,))
#: Words up to which a line is measured by code points as well.
SHORT = 20
POINTS = Measure(
    "points", lambda line: line, F.length, "substring", _points, (16,), lambda line: F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) < SHORT
)
MEASURES = (POINTS, WORDS)
#: Lines of a group that are compared with each other, and segments that a part with one edit is divided into.
GROUP, DIVISION = 48, 8
#: Shared keys (8 bytes each) that may be broadcast, after counting.
BROADCAST_ROWS = 500_000
_LEAST = -(1 << 63)


def near_units(left: Column, right: Column, k: int) -> Column:
    """Whether two arrays are within k edits, by a banded bit-parallel automaton.

    State e is a bit vector over the 2k + 1 diagonals of the band: bit d + k says that the first i units of the right one
    match the first i + d of the left one with at most e edits. A unit of the right one moves all diagonals at once: a match
    keeps the diagonal where the units agree, a substitution keeps it at one edit more, an insertion moves it down and a
    deletion up."""
    band = (1 << (2 * k + 1)) - 1

    def automaton(pair: Column) -> Column:
        left, right = pair["a"], pair["b"]
        equal = F.transform(
            right,
            lambda c, i: sum((F.when(F.get(left, i + d) == c, F.lit(1 << (d + k))).otherwise(0) for d in range(-k, k + 1)), F.lit(0)),
        )
        first = F.struct(*[F.lit(sum(1 << (d + k) for d in range(e + 1))).alias(f"r{e}") for e in range(k + 1)])

        def step(state: Column, eq: Column) -> Column:
            out, before = [], None
            for e in range(k + 1):
                now = state[f"r{e}"].bitwiseAND(eq)
                if e:
                    old = state[f"r{e - 1}"]
                    now = now.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(before, 1)).bitwiseAND(F.lit(band))
                out.append(now.alias(f"r{e}"))
                before = now
            return F.struct(*out)

        last = F.aggregate(equal, first, step)[f"r{k}"]
        apart = F.size(left) - F.size(right)
        return last.bitwiseAND(F.get(F.array(*[F.lit(1 << d) for d in range(2 * k + 1)]), apart + k)) != 0

    return F.when(F.abs(F.size(left) - F.size(right)) <= k, bound(F.struct(left.alias("a"), right.alias("b")), automaton)).otherwise(F.lit(False))


def near(a: Column, b: Column, k: int = 1) -> Column:
    """Whether two strings are within k edits of code points."""
    return near_units(_points(a), _points(b), k)


def _within(a: Column, b: Column, measure: Measure) -> Column:
    """Whether two arrays of units are as near as the measure allows for the shorter one."""
    k = measure.allowed(F.least(F.size(a), F.size(b)))
    return reduce(lambda rest, e: F.when(k == e, near_units(a, b, e)).otherwise(rest), range(1, len(measure.steps) + 1), F.lit(False))


def lines(docs: DataFrame) -> DataFrame:
    """(o, h, n, line) of every line that is not blank: o and h place the document, n the line."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("o"), F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n", -1)).alias("n", "line")
    ).filter(F.col("line").rlike(r"\S"))


def _place() -> Column:
    return F.struct("o", "h", "n")


# --- keys ------------------------------------------------------------------------------------------------------------


# Expressions that repeat for every segment and place are written as SQL text, over the columns that are named in them.


def _border(length: str, i: int, of: int) -> str:
    return f"CAST({length} * {i} / {of} AS INT)"


def _windows(b: int, apart: int | None = None):
    """(segment, offset) of the places where a segment can be that is whole between parts with at most b edits: within j of
    its own place and within b - j of it counted from the end, where apart is by how much the probing part is longer."""
    return [(j, off) for j in range(b + 1) for off in range(-j, j + 1) if apart is None or abs(apart - off) <= b - j]


def _probed(measure: Measure):
    """(k, shorter): a line probes lines that may have k edits and are so many units shorter."""
    return [(k, shorter) for k in range(1, len(measure.steps) + 1) for shorter in range(k + 1)]


def _may_have(measure: Measure, k: int, m: str) -> str:
    """Whether a line of m units may have k edits, no more and no fewer."""
    return f"{m} >= {measure.steps[k - 1]}" + (f" AND {m} < {measure.steps[k]}" if k < len(measure.steps) else "")


def _key(measure: Measure, m: str, k: int, j: int, off: int) -> str:
    """Key of 61 bits of the segment j of a line of m units, found in value at its place and off."""
    begin, end = _border(m, j, k + 1), _border(m, j + 1, k + 1)
    return f"shiftright(xxhash64('{measure.name}', {m}, {j}, {measure.cut}(value, {begin} + {off + 1}, {end} - {begin})), 3)"


def _keys(measure: Measure, number: int) -> str:
    """Keys of a line with value and n, times eight: plus twice the measure's number, plus one if it is a segment of its own
    and not a probe of lines up to k units shorter."""
    found = []
    for k, shorter in _probed(measure):
        m = f"(n - {shorter})"
        some = ", ".join(f"shiftleft({_key(measure, m, k, j, off)}, 3) | {2 * number + int(shorter == off == 0)}L" for j, off in _windows(k, shorter))
        found.append(f"CASE WHEN {_may_have(measure, k, m)} THEN array({some}) ELSE CAST(array() AS ARRAY<BIGINT>) END")
    return f"concat({', '.join(found)})"


def _keyed(every: DataFrame, measures: tuple[Measure, ...], *columns: Column) -> DataFrame:
    """(key, number, own) with the given columns of every for all keys of its lines; number: that of the measure.

    The filter keeps nothing out. It keeps the keys out of whole-stage code generation, whose one method would be too long for
    the JVM to compile; outside of it they become methods of their own. The outer explode is for the optimizer, which else
    would ask for the size of the keys, and compute them, once more."""
    rows = every.select(*columns, *[c for i, x in enumerate(measures) for c in (x.value(F.col("line")).alias(f"value{i}"), x.holds(F.col("line")).alias(f"holds{i}"))])
    names = rows.columns[: len(columns)]
    rows = rows.withColumns({f"n{i}": F.when(F.col(f"holds{i}"), x.size(F.col(f"value{i}"))).otherwise(0) for i, x in enumerate(measures)})
    own = [re.sub(r"\b(value|n)\b", rf"\g<1>{i}", _keys(x, i)) for i, x in enumerate(measures)]
    rows = rows.select(*names, F.expr(f"filter(concat({', '.join(own)}), x -> x IS NOT NULL)").alias("keys"))
    rows = rows.select(*names, F.explode_outer("keys").alias("e")).filter("e IS NOT NULL")
    return rows.select(F.shiftright("e", 3).alias("key"), F.shiftright("e", 1).bitwiseAND(3).alias("number"), F.col("e").bitwiseAND(1).alias("own"), *names)


def _shared_keys(every: DataFrame, measures: tuple[Measure, ...]) -> DataFrame:
    """Keys that an index entry and another line have."""
    counted = _keyed(every, measures, F.xxhash64("line").alias("l")).groupBy("key").agg(F.min("l").alias("a"), F.max("l").alias("b"), F.max("own").alias("own"))
    return counted.filter("a <> b AND own = 1").select("key")


def _met(every: DataFrame, measures: tuple[Measure, ...]) -> DataFrame:
    """(key, number, place, line) of the lines under shared keys; of equal lines the first."""
    shared = cut(_shared_keys(every, measures))
    few = shared.count() <= BROADCAST_ROWS
    place = _place().alias("place")
    if few:
        rows = _keyed(every, measures, place, F.col("line")).join(F.broadcast(shared), "key")
    else:  # the lines come back by their places, so that keys travel without them
        places = cut(_keyed(every, measures, place, F.xxhash64("line").alias("l")).join(shared.hint("merge"), "key").groupBy("key", "number", "l").agg(F.min("place").alias("place")))
        wanted = every.select(place, "line").join(places.select("place").distinct().hint("merge"), "place").dropDuplicates(["place"])
        rows = places.join(wanted.hint("merge"), "place")
    out = cut(rows.groupBy("key", "number", "line").agg(F.min("place").alias("place")))
    discard(shared)
    return out


# --- groups ----------------------------------------------------------------------------------------------------------


def _has_earlier(x: Column, others: Column, measure: Measure) -> Column:
    return F.exists(others, lambda y: (y["place"] < x["place"]) & _within(y["units"], x["units"], measure))


def _compared(rows: DataFrame, measure: Measure) -> DataFrame:
    """Places of the lines of small groups that have an earlier near one."""
    groups = rows.groupBy("key").agg(F.collect_set(F.struct("place", "units")).alias("all"))
    return groups.filter(F.size("all") > 1).select(F.explode(F.filter("all", lambda x: _has_earlier(x, F.col("all"), measure))).alias("x")).select("x.place")


def _against_first(rows: DataFrame, measure: Measure) -> DataFrame:
    """rows with done: the line is the earliest of its group, or near it (close)."""
    first = rows.groupBy("key").agg(F.min(F.struct("place", "units")).alias("first"))
    close = _within(F.col("first.units"), F.col("units"), measure) & (F.col("first.place") < F.col("place"))
    told = rows.join(first.hint("merge"), "key").withColumn("close", close)
    return told.withColumn("done", F.col("done") | F.col("close") | (F.col("first.place") == F.col("place"))).drop("first")


def _part(a: str, n: str, m: str, b: int) -> str:
    return f"named_struct('a', {a}, 'n', {n}, 'm', {m}, 'b', {b})"


def _parts(rows: DataFrame, measure: Measure) -> DataFrame:
    """rows with what lies beside the shared segment: array of (a, n, m, b) for n units at a, beside m units of the index
    entry, with at most b edits. A line that has its key by several segments gives a row for each."""
    found = []
    for k, shorter in _probed(measure):
        m = f"(n - {shorter})"
        for j, off in _windows(k, shorter):
            begin, end = _border(m, j, k + 1), _border(m, j + 1, k + 1)
            beside = f"array({_part('0', f'{begin} + {off}', begin, j)}, {_part(f'{end} + {off}', f'n - {end} - {off}', f'{m} - {end}', k - j)})"
            found.append(f"CASE WHEN {_may_have(measure, k, m)} AND {_key(measure, m, k, j, off)} = key THEN {beside} END")
    valued = rows.withColumns({"value": measure.value(F.col("line")), "n": F.size("units")})
    parts = valued.withColumn("all", F.expr(f"array_compact(array({', '.join(found)}))"))
    return parts.select(*[c for c in rows.columns if c != "line"], F.explode_outer("all").alias("parts")).filter("parts IS NOT NULL")


def _longest() -> Column:
    """Index of the part to divide: the longest that is longer than the edits it may have; null if there is none."""
    ranked = F.transform("parts", lambda p, i: F.struct(F.when((p["b"] > 0) & (p["m"] > p["b"]), p["m"]).otherwise(-1).alias("m"), (-i).alias("i")))
    best = F.array_max(ranked)
    return F.when(best["m"] >= 0, -best["i"])


def _divided(rows: DataFrame, most: int) -> DataFrame:
    """rows with their longest part divided into segments: new keys, and two shorter parts in its place."""
    found = []
    for j in range(DIVISION):  # one edit: all but one of the segments are whole, counted from both ends
        begin, end = _border("part.m", j, DIVISION), _border("part.m", j + 1, DIVISION)
        around = f"slice(units, part.a + 1, {begin}), slice(units, part.a + part.n - part.m + {end} + 1, part.m - {end})"
        inside = f"array({_part(f'part.a + {begin}', f'part.n - part.m + {end} - {begin}', f'{end} - {begin}', 1)})"
        fits = f"part.b = 1 AND abs(part.n - part.m) <= 1 AND {end} > {begin} AND part.n - part.m + {end} - {begin} >= 0"
        found.append(f"CASE WHEN {fits} THEN named_struct('key', shiftright(xxhash64(key, longest, {j}, {around}), 3), 'parts', concat(rest, {inside})) END")
    for b in range(2, most + 1):
        for j, off in _windows(b):
            begin, end = _border("part.m", j, b + 1), _border("part.m", j + 1, b + 1)
            key = f"shiftright(xxhash64(key, longest, {j}, slice(units, part.a + {begin} + {off + 1}, {end} - {begin})), 3)"
            beside = f"array({_part('part.a', f'{begin} + {off}', begin, j)}, {_part(f'part.a + {end} + {off}', f'part.n - {end} - {off}', f'part.m - {end}', b - j)})"
            found.append(f"CASE WHEN part.b = {b} AND abs(part.n - part.m - {off}) <= {b - j} THEN named_struct('key', {key}, 'parts', concat(rest, {beside})) END")
    cuts = rows.withColumns({"part": F.expr("get(parts, longest)"), "rest": F.expr("filter(parts, (p, i) -> i <> longest)")})
    cuts = cuts.withColumn("all", F.expr(f"array_compact(array({', '.join(found)}))"))
    return cuts.select("place", "units", "done", F.explode_outer("all").alias("e")).filter("e IS NOT NULL").select("e.key", "place", "units", "e.parts", "done")


def _in_blocks(rows: DataFrame, measure: Measure) -> DataFrame:
    """Places of the lines of large groups that are not done and have an earlier near one, block by block."""
    blocks = F.ceil(F.col("many") / GROUP).cast("int")
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("place"), blocks).cast("int"))
    own = dealt.groupBy("key", "block").agg(F.collect_set(F.struct("place", "units")).alias("all"))
    asked = rows.filter(~F.col("done")).select("key", "place", "units", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    return asked.join(own.hint("merge"), ["key", "block"]).filter(_has_earlier(F.struct("place", "units"), F.col("all"), measure)).select("place")


def near_lines(met: DataFrame, measure: Measure) -> DataFrame:
    """Places (place) of the lines of _met() that have an earlier near one by a measure."""
    level = met.select("key", "place", measure.units(F.col("line")).alias("units"), "line", F.lit(False).alias("done"))
    found, made = [], []
    while True:
        counts = level.groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min("place").alias("a"), F.max("place").alias("b")).filter("a < b").select("key", "many")
        level = cut(level.join(counts.hint("merge"), "key"))
        discard(*made)
        found.append(cut(_compared(level.filter(F.col("many") <= GROUP), measure)))
        large = level.filter(F.col("many") > GROUP)
        if large.isEmpty():
            break
        told = cut(_against_first(large, measure))
        discard(level)
        found.append(cut(told.filter("close").select("place")))
        rest = told.join(told.filter("NOT done").select("key").distinct().hint("merge"), "key", "left_semi")
        rest = cut((_parts(rest, measure) if "line" in rest.columns else rest).withColumn("longest", _longest()))
        discard(told)
        found.append(cut(_in_blocks(rest.filter("longest IS NULL"), measure)))
        level, made = _divided(rest.filter("longest IS NOT NULL"), len(measure.steps)), [rest]
    discard(level)
    out = cut(reduce(DataFrame.unionByName, found).distinct())
    discard(*found)
    return out


# --- documents -------------------------------------------------------------------------------------------------------


def dropped_lines(docs: DataFrame, measures: tuple[Measure, ...] = MEASURES) -> DataFrame:
    """(o, h, exact, near): for each document that loses lines, the numbers of its exact and of its near repeats."""
    every = lines(docs.select("doc_id", "text"))
    identity = ("l1", "l2", "l3")
    hashed = cut(every.select("o", "h", "n", F.xxhash64("line").alias("l1"), F.xxhash64(F.lit(7), "line").alias("l2"), F.length("line").alias("l3")))
    met = _met(every, measures)
    near = [near_lines(met.filter(F.col("number") == i), x) for i, x in enumerate(measures)]
    close = hashed.join(reduce(DataFrame.unionByName, near).distinct().select("place.*").hint("merge"), ["o", "h", "n"]).select(*identity).distinct().select(*identity, F.lit(True).alias("close"))
    firsts = hashed.groupBy(*identity).agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("times"))
    marked = firsts.join(close.hint("merge"), [*identity], "left").filter("close OR times > 1").select(*identity, "first", F.coalesce("close", F.lit(False)).alias("close"))
    repeat = _place() != F.col("first")
    gone = hashed.join(cut(marked).hint("merge"), [*identity]).filter(F.col("close") | repeat)
    out = cut(gone.groupBy("o", "h").agg(F.collect_set(F.when(repeat, F.col("n"))).alias("exact"), F.collect_set(F.when(~repeat, F.col("n"))).alias("near")))
    discard(hashed, met, *near)
    return out


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_lines, n_exact, n_near (lines dropped), and text, what is left of it."""
    return _applied(docs.select("doc_id", "text"), dropped_lines(docs)).select(
        "doc_id",
        F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_quarry_exact"), F.lit(0)).cast("long").alias("n_exact"),
        F.coalesce(F.size("_quarry_near"), F.lit(0)).cast("long").alias("n_near"),
        F.col("_quarry_left").alias("text"),
    )


def _applied(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs with the numbers of dropped lines and the text that is left."""
    keyed = docs.withColumns({"_quarry_o": F.coalesce(docs["doc_id"].cast("long"), F.lit(_LEAST)), "_quarry_h": F.xxhash64(docs["text"])})
    told = gone.select(F.col("o").alias("_quarry_o"), F.col("h").alias("_quarry_h"), F.col("exact").alias("_quarry_exact"), F.col("near").alias("_quarry_near"))
    joined = keyed.join(told.hint("merge"), ["_quarry_o", "_quarry_h"], "left")
    both = F.concat("_quarry_exact", "_quarry_near")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda line, i: ~F.array_contains(both, i)), "\n")
    return joined.withColumn("_quarry_left", F.when(F.col("_quarry_exact").isNull(), F.col("text")).otherwise(left))


def cleaned(docs: DataFrame) -> DataFrame:
    """docs without the repeated lines, in their own columns; n_chars (where there is one) is counted anew for documents
    that lost lines, and documents of which no code point but white space is left go."""
    done = _applied(docs, dropped_lines(docs))
    touched = F.col("_quarry_exact").isNotNull()
    done = done.filter(~touched | F.col("_quarry_left").rlike(r"\S"))
    columns = {"text": F.col("_quarry_left")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(touched, F.length("_quarry_left").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.select(*[columns.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])

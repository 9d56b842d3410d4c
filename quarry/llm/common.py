"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.session import ship

#: Bytes of text that a worker turns into Python strings at a time.
SLICE_BYTES = 8_000_000


class Kept(dict):
    """What a worker builds once and keeps (automata, tables). It travels empty, so tasks stay small."""

    def __reduce__(self):
        return Kept, ()

    def once(self, name: str, make):
        if name not in self:
            self[name] = make()
        return self[name]


def text_slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about so many bytes; a longer text is a run of its own."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def text_batches(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[tuple[list, list]]:
    """From batches whose first two columns are an id and a text: lists of both, of bounded size."""
    for batch in batches:
        for part in text_slices(batch, 1, most):
            yield part.column(0).to_pylist(), part.column(1).to_pylist()


def interval_of(value: Column, starts: list, key=F.lit) -> Column:
    """How many of the ascending starts are at or below the value, by binary search in a literal array."""
    if not starts:
        return F.lit(0)
    known = F.array(*map(key, starts))
    steps = [1 << b for b in reversed(range(len(starts).bit_length()))]
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when((at + step <= len(starts)) & (F.get(known, at + step - 1) <= value), at + step).otherwise(at),
    )


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once per row, also where use mentions it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


ship(__name__)

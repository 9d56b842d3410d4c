"""Packing of tokenised documents into fixed-size sequences by harmonic packing.

Method. A document (its token ids and a final id 0) is cut into pieces whose lengths suit reciprocals of the capacity C:
whole sequences, then one piece for each binary digit of the rest down to C/32, then a tail shorter than that. A piece of
length n is in the class i = C // n: i pieces of a class fill one bin, whatever else the class holds, so every worker fills
the bins of each class by itself while it tokenises. Pieces of the lengths C, C/2 ... C/32 fill their bins without any
padding; a bin of tails is padded by less than a tail. What a worker has left in unfilled bins (less than a bin for each
class) is filled up class by class over groups of workers, then over all; the last few pieces, less than one bin for each
class, are laid out one after another.

Scale. One pass over the texts; only unfilled bins are shuffled, as rows of a few numbers. No step gathers more than
(number of workers) x (one bin) rows of a class in a task, and the last one less than a bin for each class.

Defined cases: a null or empty text is one piece holding id 0; repeated rows and repeated or null doc_ids are packed as
rows of their own; an empty table gives no rows; other columns are not read. Sequence ids are unique, not consecutive.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import text_batches
from quarry.session import cut, ship

CAPACITY = 1024
#: Binary digits of a document's rest that become pieces of their own: down to capacity / 32.
DIGITS = 5
#: Words in one generation of a worker's cache; it holds two.
CACHED_WORDS = 400_000
#: Workers whose unfilled bins are filled up together in the first round.
GROUP = 256
#: Bits of a sequence id: round, worker or group, class, bin.
WORKER_BITS, CLASS_BITS, BIN_BITS = 24, 11, 26

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, kind int, worker int, nr long, sequence_id long, offset long"

#: Letters of the fast path; every other character sends its whole text to the tokenizer itself.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[\t\n\r\x20-\x7e{_LETTERS}]*\Z")
_WORD = re.compile(rf" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")


class _WordIds(dict):
    """Ids of a word as little-endian unsigned 32-bit numbers, kept for the words of the present and the last generation."""

    def __init__(self, encode):
        self.encode, self.last = encode, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.last = dict(self)
            self.clear()
        ids = self[word] = self.last.get(word) or self.encode(word)
        return ids


def text_encoder(tokenizer_path: str):
    """A function from text to ids as little-endian bytes, equal to the tokenizer file's own ids without special tokens.

    The file's pre-tokenizer splits a text into words and encodes each by itself, so texts of plain characters are
    split here and every distinct word is encoded once; other texts, and texts that hold an added token's string, go
    through the tokenizer whole."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path)
    added = [t["content"] for t in json.load(open(tokenizer_path, encoding="utf-8")).get("added_tokens", [])]

    def encode(text: str) -> bytes:
        return np.asarray(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    words = _WordIds(_word_encoder(tokenizer_path) or encode)
    get = words.__getitem__

    def ids(text: str) -> bytes:
        if _PLAIN.match(text) and not any(t in text for t in added):
            return b"".join(map(get, _WORD.findall(text)))
        return encode(text)

    return ids


def _word_encoder(tokenizer_path: str):
    """The same vocabulary in a faster library for single words, or None where the file is of another kind."""
    import tiktoken

    model = json.load(open(tokenizer_path, encoding="utf-8"))
    if model["model"].get("type", "BPE") != "BPE" or (model.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in printable}
    shown |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in printable)}
    ranks = {bytes(shown[c] for c in token): i for token, i in model["model"]["vocab"].items() if all(c in shown for c in token)}
    for t in model.get("added_tokens", []):
        ranks.pop(t["content"].encode(), None)
    core = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    if array("I").itemsize != 4 or sys.byteorder != "little":
        return lambda word: np.array(core.encode_ordinary(word), "<u4").tobytes()
    return lambda word: array("I", core.encode_ordinary(word)).tobytes()


def piece_lengths(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces in order."""
    whole, rest = divmod(tokens, capacity)
    out = [capacity] * whole
    for digit in range(1, DIGITS + 1):
        if rest >= (part := capacity >> digit):
            out.append(part)
            rest -= part
    return out + [rest] * (rest > 0)


def sequence_number(level, worker, kind, bin_):
    """Unique id of a bin; works on numbers and on columns alike."""
    return ((level * (1 << WORKER_BITS) + worker) * (1 << CLASS_BITS) + kind) * (1 << BIN_BITS) + bin_


def _tokenise(tokenizer_path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = text_encoder(tokenizer_path)
        worker = TaskContext.get().partitionId()
        names = [f.split()[0] for f in PIECES.split(", ")]
        opened: dict[int, list[list]] = {}
        bins: dict[int, int] = {}
        out: list[list] = []
        nr = held = 0

        def flush(rows: list[list]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 3 + [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for doc_ids, texts in text_batches(batches):
            for doc_id, text in zip(doc_ids, texts):
                ids = encode(text or "") + b"\0\0\0\0"
                tokens, start = len(ids) // 4, 0
                for length in piece_lengths(tokens, capacity):
                    kind = capacity // length
                    row = [doc_id, start, length, ids[4 * start : 4 * (start + length)], tokens, kind, worker, nr, None, None]
                    nr += 1
                    start += length
                    waiting = opened.setdefault(kind, [])
                    waiting.append(row)
                    if len(waiting) == kind:
                        sequence = sequence_number(0, worker, kind, bins.get(kind, 0))
                        bins[kind] = bins.get(kind, 0) + 1
                        offset = 0
                        for r in waiting:
                            r[8:], offset = [sequence, offset], offset + r[2]
                        out += waiting
                        waiting.clear()
                held += len(ids)
                if held > 4_000_000:
                    if out:
                        yield flush(out)
                    out, held = [], 0
        out += [r for waiting in opened.values() for r in waiting]
        if out:
            yield flush(out)

    return run


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """All pieces with their ids; sequence_id and offset are null where a worker could not fill the piece's bin."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenise(tokenizer_path, capacity), PIECES)


def _fill(pieces: DataFrame, level: int, worker) -> DataFrame:
    """Fill bins of each class within each worker group; pieces of unfilled bins keep null."""
    group = Window.partitionBy("worker", "kind")
    ordered = group.orderBy("source", "nr")
    in_bin = Window.partitionBy("worker", "kind", "bin").orderBy("source", "nr")
    return (
        pieces.withColumn("source", F.coalesce("source", "worker") if "source" in pieces.columns else F.col("worker"))
        .withColumn("worker", worker)
        .withColumn("place", F.row_number().over(ordered) - 1)
        .withColumn("many", F.count(F.lit(1)).over(group))
        .withColumn("bin", F.floor(F.col("place") / F.col("kind")))
        .withColumn("before", F.sum("length").over(in_bin.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("full", (F.col("bin") + 1) * F.col("kind") <= F.col("many"))
        .withColumn("sequence_id", F.when(F.col("full"), sequence_number(F.lit(level).cast("long"), F.col("worker"), F.col("kind"), F.col("bin"))))
        .withColumn("offset", F.when(F.col("full"), F.coalesce("before", F.lit(0).cast("long"))))
        .drop("place", "many", "bin", "before", "full")
    )


def _rest(pieces: DataFrame, capacity: int) -> DataFrame:
    """Lay out the last pieces, less than one bin for each class: exact parts of the capacity from the longest on, so
    that none crosses a bin's end, and tails by the place where they start, with room for one more tail."""
    tail = capacity >> DIGITS
    exact = F.col("length") >= tail
    room = F.when(exact, capacity).otherwise(capacity - tail + 1)
    stream = Window.partitionBy("exact").orderBy(F.desc("length"), "source", "nr")
    in_bin = Window.partitionBy("exact", "bin").orderBy(F.desc("length"), "source", "nr").rowsBetween(Window.unboundedPreceding, -1)
    return (
        pieces.withColumn("exact", exact)
        .withColumn("at", F.coalesce(F.sum("length").over(stream.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
        .withColumn("bin", F.floor(F.col("at") / room))
        .withColumn("sequence_id", sequence_number(F.lit(3).cast("long"), F.lit(0), F.col("exact").cast("int"), F.col("bin")))
        .withColumn("offset", F.coalesce(F.sum("length").over(in_bin), F.lit(0).cast("long")))
        .drop("exact", "at", "bin")
    )


def settle(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece its sequence_id and offset. pieces: from tokenised_pieces(), other columns as they like."""
    payload = [c for c in pieces.columns if c not in ("kind", "worker", "nr")]
    made = cut(pieces)
    first = cut(_fill(made.filter("sequence_id IS NULL"), 1, F.floor(F.col("worker") / GROUP).cast("int")))
    second = cut(_fill(first.filter("sequence_id IS NULL"), 2, F.lit(0)))
    last = _rest(second.filter("sequence_id IS NULL"), capacity)
    parts = [made, first, second]
    return (
        parts[0].filter("sequence_id IS NOT NULL").select(payload)
        .unionByName(first.filter("sequence_id IS NOT NULL").select(payload))
        .unionByName(second.filter("sequence_id IS NOT NULL").select(payload))
        .unionByName(last.select(payload))
    )


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    return settle(tokenised_pieces(docs, tokenizer_path, capacity), capacity)


ship(__name__)

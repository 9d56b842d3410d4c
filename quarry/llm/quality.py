"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

    score(x) = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])

The pairwise term is the sum-of-squares identity, so a text is scored in time linear in its features.

Features of a text: square roots of the shares of its words in 2^10 hash buckets; statistics of its structure (shares of
letters, capitals, digits, signs, spaces and line ends, word and line lengths, repeated words and lines, words that end or
consist in signs, the commonest sign); and metadata of the text (length in code points and bytes). All come from the text
alone: labels, language, source and id are never inputs.

Training: labelled rows whose crc32(doc_id as text) mod 3 is not 1, at most TRAINING_ROWS of them (those with the smallest
hash of their id, so any partitioning picks the same). Features are computed on the executors; the driver gets that
bounded matrix only, and fits by Adam with a fixed seed. Scoring is one pass with the fitted arrays, without a shuffle.

Defined cases: null and empty texts have zero features besides length and get a score too; documents with several labels
take the one given most often (the larger on a tie), labels that are null or not 0 or 1 and rows without a document are
left out; with no labels of one class the score is the smoothed share of label 1 (0.5 without labels); repeated rows are
scored alike; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import text_batches
from quarry.llm.features import buckets, chunks, word_hashes
from quarry.session import ship

#: Bound of the training sample, and the hash buckets of words.
TRAINING_ROWS, WIDTH = 6000, 1024
RANK, EPOCHS, BATCH, RATE, DECAY, SEED = 8, 30, 128, 0.01, 1e-4, 7

_SIGNS = b"!#$%&*+/<=>?@[\\]^_`{|}~"
_CLASS = np.zeros(256, np.int64)
for _c in range(256):
    _CLASS[_c] = 1 if 97 <= _c <= 122 else 2 if 65 <= _c <= 90 else 3 if 48 <= _c <= 57 else 4 if _c == 32 else 5 if _c == 10 else 6 if _c >= 128 else 7 if _c in _SIGNS else 8 if 33 <= _c <= 126 else 0
STATISTICS = 24


def features(text: str | None) -> np.ndarray:
    """The feature vector of a text, WIDTH word buckets and STATISTICS numbers, all of about unit size."""
    out = np.zeros(WIDTH + STATISTICS, np.float32)
    data = (text or "").encode("utf-8", "replace")
    if not data:
        return out
    words = np.zeros(WIDTH, np.int64)
    kinds = np.zeros(256, np.int64)
    count = ending = only = joined = 0
    seen: list[np.ndarray] = []
    for part in chunks(data):
        array = np.frombuffer(part, np.uint8)
        kinds += np.bincount(array, minlength=256)
        hashes = word_hashes(part)
        words += np.bincount(buckets(hashes, WIDTH), minlength=WIDTH)
        count += len(hashes)
        seen.append(hashes)
        kind = _CLASS[array]
        sign, space = kind == 7, array <= 32
        last = np.append(space[1:], True)
        first = np.append(True, space[:-1])
        ending += int((sign & last).sum())
        only += int((sign & last & first).sum())
        joined += int((hashes[1:] == hashes[:-1]).sum())
    by_class = np.bincount(_CLASS, weights=kinds, minlength=9)
    size, letters = len(data), by_class[1] + by_class[2] + by_class[6]
    hashes = np.concatenate(seen)
    _, times = np.unique(hashes, return_counts=True)
    lines = Counter(data.split(b"\n"))
    n_lines = sum(lines.values())
    signs = kinds[list(_SIGNS)]
    n = max(count, 1)
    if count:
        out[:WIDTH] = np.sqrt(words / count)
    out[WIDTH:] = [
        *(by_class[1:9] / size),
        by_class[2] / max(letters, 1),
        ending / n, only / n, joined / n,
        len(times) / n, (times.max() if count else 0) / n, np.log1p(count) / 10 * (len(times) < 0.5 * n),
        np.log1p(size) / 15, np.log1p(len(text or "")) / 15, min(size / n, 40) / 20,
        n_lines / n, len(lines) / n_lines, max(lines.values()) / n_lines, min(size / n_lines, 4000) / 2000,
        signs.max() / size, kinds[ord("|")] / n,
    ]
    return out


class Machine:
    """A fitted factorisation machine: a few arrays, small enough to travel with every task."""

    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.w0 + x @ self.w + 0.5 * (np.square(x @ self.v) - np.square(x) @ np.square(self.v)).sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x.astype(np.float64)), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Machine:
    """Logistic loss, Adam, fixed seed; a constant where a class is missing."""
    width = x.shape[1]
    share = (y.sum() + 1) / (len(y) + 2)
    w0, w = float(np.log(share / (1 - share))), np.zeros(width)
    random = np.random.default_rng(SEED)
    v = random.normal(0, 0.05, (width, RANK))
    if len(set(y.tolist())) < 2:
        return Machine(w0, w, v * 0)
    values = [np.array([w0]), w, v]
    first, second, step = [np.zeros_like(p) for p in values], [np.zeros_like(p) for p in values], 0
    x, y = x.astype(np.float64), y.astype(np.float64)
    for _ in range(EPOCHS):
        order = random.permutation(len(y))
        for at in range(0, len(y), BATCH):
            some = order[at : at + BATCH]
            a, step = x[some], step + 1
            sums = a @ values[2]
            squares = np.square(a)
            raw = values[0] + a @ values[1] + 0.5 * (np.square(sums) - squares @ np.square(values[2])).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[some]) / len(some)
            slopes = [np.array([error.sum()]), a.T @ error + DECAY * values[1], a.T @ (error[:, None] * sums) - (squares.T @ error)[:, None] * values[2] + DECAY * values[2]]
            for i, g in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * np.square(g)
                values[i] = values[i] - RATE * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Machine(float(values[0][0]), values[1], values[2])


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for labels, texts in text_batches(batches):
        rows = [features(t).tobytes() for t in texts]
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int64()), pa.array(rows, pa.binary())], names=["y", "x"])


def trained(docs: DataFrame, labels: DataFrame, column: str = "quality") -> Machine:
    """A machine fitted to a bounded sample of the labelled documents that are not held out."""
    votes = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("long").alias("y"))
        .filter(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.avg("y") >= 0.5).cast("long").alias("y"))
    )
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(votes, "doc_id").distinct()
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = texts.select("y", "text", "doc_id").dropDuplicates(["doc_id"]).select("y", "text").mapInArrow(_featured, "y long, x binary").collect()
    rows.sort(key=lambda r: (r.x, r.y))
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows], np.float32).reshape(len(rows), WIDTH + STATISTICS)
    return fit(x, np.array([r.y for r in rows], np.int64))


def scorer(machine: Machine):
    """A column function from texts to scores, None and empty texts included."""

    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out = [np.zeros(0)]
            for at in range(0, len(texts), 256):
                out.append(machine.scores(np.array([features(t) for t in texts.iloc[at : at + 256]], np.float32)))
            yield pd.Series(np.concatenate(out))

    return F.pandas_udf(score, "double")


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted (1 from 0.5 on)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scorer(machine)("text").alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def kept(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of docs that the machine does not reject, with their own columns only."""
    return docs.filter(scorer(machine)("text") >= 0.5)


ship(__name__)

"""Language identification by error-correcting output codes.

Each language has a codeword; one binary classifier over hashed byte n-grams predicts each bit. Decoding is weighted by
loss: a language's loss is the sum over bits of the logistic loss of the classifier's margin against the codeword's bit,
and the language of least loss wins, so an unsure bit costs little and a wrong one can be outvoted. score is the winner's
share under exp(-loss); a text is flagged as ambiguous where the runner-up's share comes close.

Codewords: for up to seven languages the exhaustive code (every way to split the languages in two), beyond that the best
of a fixed number of random codes by least distance. Features: square roots of the shares of byte 1-, 2- and 3-grams of
the lower-cased text, ASCII signs and digits blanked, in 2^12 hash buckets; the whole text counts.

Training: documents with a language whose crc32(doc_id as text) mod 5 is not 0, about PER_LANGUAGE of each of the
MOST_LANGUAGES most frequent languages (less where that would exceed MOST_ROWS in all: then the same number of each),
chosen by the hash of their id. Languages beyond those are never predicted. The driver gets their features only, in half precision, and computes in single precision.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text where there is nothing to
learn from; with a single language every text with a letter is of it, with score 1; ties go to the first by name; repeated
rows are judged alike; an empty table gives no rows; lang, source and id are never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import text_batches
from quarry.llm.features import CHUNK, buckets
from quarry.session import ship

WIDTH, LONGEST_GRAM = 4096, 3
#: Bounds of the training sample.
PER_LANGUAGE, MOST_LANGUAGES, MOST_ROWS = 1200, 256, 20_000
EPOCHS, RATE, DECAY, SEED, CODES = 150, 0.05, 1e-4, 11, 200
#: The runner-up's share of the winner's from which a text is ambiguous.
CLOSE = 0.5
UNKNOWN = "und"

_BLANK = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def features(text: str | None) -> np.ndarray:
    """Square roots of the shares of n-grams in hash buckets."""
    data = (text or "").lower().encode("utf-8", "replace").translate(_BLANK)
    counts = np.zeros(WIDTH, np.int64)
    for at in range(0, len(data), CHUNK):
        array = np.frombuffer(data[at : at + CHUNK + LONGEST_GRAM - 1], np.uint8).astype(np.uint64) + np.uint64(1)
        new = min(CHUNK, len(data) - at)
        hashes = np.zeros(len(array), np.uint64)
        for n in range(LONGEST_GRAM):
            if n >= len(array):
                break
            hashes = (hashes[: len(array) - n] + array[n:]) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (hashes[:new] ^ (hashes[:new] >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
            counts += np.bincount(buckets(mixed, WIDTH), minlength=WIDTH)
    return np.sqrt(counts / max(1, counts.sum())).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def codewords(languages: int) -> np.ndarray:
    """A row of -1 and 1 for each language."""
    if languages <= 1:
        return np.ones((languages, 0))
    if languages <= 7:
        splits = range(1, 1 << (languages - 1))
        return np.array([[1 if split >> i & 1 else -1 for split in splits] for i in range(languages)], float)
    random, best, reach = np.random.default_rng(SEED), None, -1
    bits = int(np.ceil(10 * np.log2(languages)))
    for _ in range(CODES):
        code = random.choice([-1.0, 1.0], (languages, bits))
        apart = (bits - code @ code.T) / 2
        near = apart[~np.eye(languages, dtype=bool)].min()
        if near > reach:
            best, reach = code, near
    return best


class Decoder:
    """Languages, their codewords and the classifiers of the bits."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.languages, self.code, self.weights, self.bias = languages, code, weights, bias

    def shares(self, x: np.ndarray) -> np.ndarray:
        """For each row the share of each language under exp(-loss)."""
        margins = x.astype(np.float64) @ self.weights + self.bias
        losses = np.log1p(np.exp(-np.clip(margins[:, None, :] * self.code[None], -30, 30))).sum(axis=2)
        shares = np.exp(losses.min(axis=1, keepdims=True) - losses)
        return shares / shares.sum(axis=1, keepdims=True)

    def decide(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        names, scores, unsure = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
        at = [i for i, t in enumerate(texts) if has_letter(t)] if self.languages else []
        for a in range(0, len(at), 256):
            some = at[a : a + 256]
            shares = self.shares(np.array([features(texts[i]) for i in some]))
            best = shares.argmax(axis=1)
            for i, row, k in zip(some, shares, best):
                names[i], scores[i] = self.languages[k], float(row[k])
                unsure[i] = bool(len(row) > 1 and np.sort(row)[-2] >= CLOSE * row[k])
        return names, scores, unsure


def fit(x: np.ndarray, names: list[str]) -> Decoder:
    """One logistic classifier per bit, all at once, by Adam over the whole sample; languages weigh alike."""
    languages = sorted(set(names))
    code = codewords(len(languages))
    at = np.array([languages.index(n) for n in names], int)
    weights, bias = np.zeros((x.shape[1], code.shape[1])), np.zeros(code.shape[1])
    if code.shape[1]:
        signs = code[at]
        weight = (1 / np.bincount(at)[at] / len(languages))[:, None]
        x = x.astype(np.float32, copy=False)
        values = [weights, bias]
        first, second = [np.zeros_like(p) for p in values], [np.zeros_like(p) for p in values]
        for step in range(1, EPOCHS + 1):
            margin = signs * (x @ values[0].astype(np.float32) + values[1])
            error = -signs * weight / (1 + np.exp(np.clip(margin, -30, 30)))
            for i, g in enumerate([x.T @ error.astype(np.float32) + DECAY * values[0], error.sum(axis=0)]):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * np.square(g)
                values[i] = values[i] - RATE * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        weights, bias = values
    return Decoder(languages, code, weights, bias)


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for names, texts in text_batches(batches):
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([features(t).astype(np.float16).tobytes() for t in texts], pa.binary())], names=["lang", "x"])


def trained(docs: DataFrame) -> Decoder:
    """A decoder fitted to a sample of the documents that are not held out, bounded for each language by itself."""
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    if not counts:
        return fit(np.zeros((0, WIDTH), np.float32), [])
    each = min(PER_LANGUAGE, MOST_ROWS // len(counts))
    share = F.create_map(*[F.lit(v) for r in counts for v in (r.lang, min(1.0, each / r["count"]))])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000.0
    chosen = usable.withColumn("place", place).filter(F.col("place") < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id", F.xxhash64("text")))
    sample = chosen.withColumn("rank", rank).filter(F.col("rank") <= each)
    rows = sample.select("lang", "text").mapInArrow(_featured, "lang string, x binary").collect()
    rows.sort(key=lambda r: (r.lang, r.x))
    x = np.zeros((len(rows), WIDTH), np.float32)
    for i, r in enumerate(rows):
        x[i] = np.frombuffer(r.x, np.float16)
    return fit(x, [r.lang for r in rows])


def identified(docs: DataFrame, decoder: Decoder) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score, ambiguous."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_batches(batches):
            names, scores, unsure = decoder.decide(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")


ship(__name__)

"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A sketch is the ascending array of the K smallest distinct 64-bit hashes of a text's 5-word shingles (words: runs without
ASCII white space, lower-cased; a text of fewer words is one shingle; a text without words has the empty sketch). Sketches
merge: the K smallest of the union are the sketch of the texts together. From two sketches follow, over the K smallest
hashes of their union, the resemblance (share of them that both hold), the containment and the number of distinct shingles.

The query pairs every document with the next one by (doc_id, hash of the text). Documents are dealt to buckets of about
BUCKET_ROWS rows (more beyond MOST_BUCKETS buckets: 2 GB of text each at 100 TB). The borders come from a random sample of
the ids, about SAMPLED a bucket, and shape the work only, never a result; an id with the rows of HOT buckets is cut into
parts by the hash of its texts. The first rows of each bucket are also given to the bucket before it (and of the first to
the last), so that "next" is a window inside a bucket and the texts are shuffled once.

Defined cases: a null text is empty; two empty sketches are alike (1), an empty and another are not (0); null doc_ids
come first; rows of one doc_id are ordered by the hash of their text, and of equal rows each other's next may be either;
one document alone is its own next; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import bound

K, WORDS = 128, 5
BUCKET_ROWS, MOST_BUCKETS = 1000, 50_000
SAMPLED, HOT = 8, 4
_SPACE = r"[\x20\x09-\x0D]+"
_LEAST = -(1 << 63)


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of all shingles of a text, repeats included."""
    split = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPACE), lambda w: w != "")
    hashed = F.transform(split, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        starts = F.slice(h, 1, F.greatest(F.size(h) - (words - 1), F.lit(0)))
        long = F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(h, i + n) for n in range(1, words)]))
        return F.when(F.size(h) >= words, long).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return bound(hashed, shingles)


def sketch(text: Column, k: int = K) -> Column:
    """The bottom-k sketch of a text."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two sketches' texts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets, exact while both have at most k shingles."""
    union = merged(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(shared / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the share of the hash range up to the k-th."""
    share = (F.element_at(a, k).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's distinct shingles that b has too."""
    both = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def merge_all(sketches: DataFrame, by: list[str], column: str, k: int = K) -> DataFrame:
    """One sketch for each group: the k smallest distinct hashes of all, ranked within salted parts first so that no task
    gathers a group."""
    hashes = sketches.select(*by, F.explode(column).alias("h")).distinct()
    salted = hashes.withColumn("salt", F.pmod("h", F.lit(64)))
    within = salted.withColumn("n", F.row_number().over(Window.partitionBy(*by, "salt").orderBy("h"))).filter(F.col("n") <= k)
    ranked = within.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).filter(F.col("n") <= k)
    return ranked.groupBy(*by).agg(F.sort_array(F.collect_list("h")).alias(column))


def as_text(a: Column) -> Column:
    """A sketch as hexadecimal digits, 16 a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _place() -> Column:
    """Where a document stands among all: by its id, null first."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST))


def _part(h: Column, parts: Column) -> Column:
    """Which of so many equal parts of the hash range holds h."""
    return F.least(F.floor((h.cast("double") + 2.0**63) / 2.0**64 * parts).cast("int"), parts - 1)


def _borders(docs: DataFrame, buckets: int | None) -> list[tuple[int, int]]:
    """The place (id, hash) at which each bucket begins, ascending: the first row's, or the least hash for all rows of an id."""
    ids = docs.select(_place().alias("o"))
    seen = ids.agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("least")).first()
    if not seen.n:
        return []
    wanted = buckets or min(MOST_BUCKETS, -(-seen.n // BUCKET_ROWS))
    if wanted == 1:
        return [(seen.least, _LEAST)]
    share = SAMPLED * wanted / seen.n
    counted = (ids.sample(share, 7) if share < 1 else ids).groupBy("o").count().collect()
    each = sum(r["count"] for r in counted) / wanted
    hot = {r.o: int(r["count"] // each) for r in counted if r["count"] >= HOT * each}
    found, held = {(seen.least, _LEAST)}, 0
    for row in sorted(counted):
        if held >= each:
            found.add((row.o, _LEAST))
            held = 0
        held += row["count"]
    if hot:
        parts = F.element_at(F.create_map(*[x for o, n in hot.items() for x in (_long(o), F.lit(n))]), F.col("o"))
        rows = docs.select(_place().alias("o"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).filter(F.col("o").isin(*hot))
        found = {x for x in found if x[0] not in hot}
        found |= {(r.o, r.h) for r in rows.groupBy("o", _part(F.col("h"), parts).alias("part")).agg(F.min("h").alias("h")).collect()}
    return sorted(found)


def _known(values) -> Column:
    """An array literal (folded from one string, so that the plan holds one value and not thousands)."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _bucket(o: Column, h: Column, starts: list[tuple[int, int]]) -> Column:
    """Index of the last start at or before (o, h), by binary search."""
    first, second = _known(x for x, _ in starts), _known(x for _, x in starts)
    begun = lambda i: (F.get(first, i) < o) | ((F.get(first, i) == o) & (F.get(second, i) <= h))
    steps = [1 << b for b in reversed(range(len(starts).bit_length()))]
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when((at + step <= len(starts)) & begun(at + step - 1), at + step).otherwise(at))
    return found - 1


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Columns doc_id, text, bucket, copy, o, h and next_text, for each row of docs and for the rows that buckets lend each
    other (copy = 1), which the caller drops once nothing looks at its next row any more."""
    starts = _borders(docs, buckets)
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), _place().alias("o")).withColumn("h", F.xxhash64("text"))
    if not starts:
        return dealt.withColumn("bucket", F.lit(0)).withColumn("copy", F.lit(0)).withColumn("next_text", F.col("text"))
    own = _bucket(F.col("o"), F.col("h"), starts).alias("own")
    first, second = (F.get(_known(x[i] for x in starts), F.col("own")) for i in (0, 1))
    begins = (F.col("o") == first) & ((second == _LEAST) | (F.col("h") == second))
    before = F.pmod(F.col("own") - 1, F.lit(len(starts)))
    places = F.array(F.struct(F.col("own").alias("bucket"), F.lit(0).alias("copy")), F.when(begins, F.struct(before.alias("bucket"), F.lit(1).alias("copy"))))
    lent = dealt.select("*", own).select("doc_id", "text", "o", "h", F.explode(places).alias("p")).filter("p IS NOT NULL").select("doc_id", "text", "o", "h", "p.bucket", "p.copy")
    return lent.withColumn("next_text", F.lead("text").over(in_bucket()))


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def in_bucket():
    return Window.partitionBy("bucket").orderBy("copy", "o", "h")


def fingerprinted(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256, sketch, edited_sketch, near_edited, near_next. The edited text has
    the first code points of the next document in place of its last quarter."""
    paired = with_next(docs, buckets)
    n = F.length("text")
    part = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - part), F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), part))
    made = paired.select("doc_id", "bucket", "copy", "o", "h", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    made = made.select(
        "doc_id", "bucket", "copy", "o", "h", "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        sketch(F.col("text")).alias("sketch"),
        F.when(F.col("copy") == 0, sketch(F.col("edited"))).alias("edited_sketch"),
    )
    following = made.withColumn("next_sketch", F.lead("sketch").over(in_bucket())).filter("copy = 0")
    return following.select(
        "doc_id", "n_chars", "edited_sha256", "sketch", "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )

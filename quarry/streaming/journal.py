"""Journals as streams: filtering with checkpoints, and the latest status of each key.

A stream over files runs with Trigger.AvailableNow: it takes what is there, stops, and resumes from its checkpoint, so a
rerun does only what is new. Batches are idempotent by batch id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema: str, kind: str = "json", files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", files).load(path)


def filtered_to(stream: DataFrame, tag, out: str, checkpoint: str) -> None:
    """Tag a stream's rows (a function that adds reason) and append kept and removed rows to two tables, once each: a batch
    that is run again replaces its own part."""

    def write(batch: DataFrame, number: int) -> None:
        told = tag(batch).withColumn("kind", F.when(F.col("reason").isNull(), "kept").otherwise("removed"))
        told.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("kind").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_status(rows: DataFrame, key: str, attempt: str) -> DataFrame:
    """The row of the highest attempt for each key, of several with one attempt the greatest as JSON text; works on streams
    (complete mode) and tables alike."""
    own = F.struct(*[c for c in rows.columns if c != key])
    return rows.groupBy(key).agg(F.max_by(own, F.struct(F.col(attempt), F.to_json(own))).alias("_r")).select(key, "_r.*")


def to_retry(latest: DataFrame, status: str, done: str = "complete") -> DataFrame:
    """Keys whose latest attempt is not done."""
    return latest.filter(~F.col(status).eqNullSafe(F.lit(done)))


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts per event-time window and key, with a watermark; an extra beside the reference's own operators."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "n")


def whole_groups(rows: DataFrame, key: str, index: str, n: int) -> DataFrame:
    """Rows of groups that are complete: exactly n rows with distinct indices. Partial groups are left out whole."""
    good = rows.groupBy(key).agg(F.count(F.lit(1)).alias("many"), F.count_distinct(index).alias("distinct")).filter((F.col("many") == n) & (F.col("distinct") == n))
    return rows.join(good.select(key), key, "left_semi")


def assigned(rows: DataFrame, index: str, workers: int) -> DataFrame:
    """Rows with the worker that a modulo assignment gives them."""
    return rows.withColumn("worker", F.pmod(F.col(index), F.lit(workers)))

"""Readers and writers: registries, JSON lines with torn tails, pinned files, step logs, split exports, manifests."""

from __future__ import annotations

import json
import re
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import checks
from quarry.session import ship

CORRUPT = "_corrupt"


def registry(spark: SparkSession, path: str) -> DataFrame:
    """A YAML registry of datasets as a table of name, role and the specification as JSON. Registries are a page long."""
    import yaml

    text = spark.read.text(path, wholetext=True).first().value
    rows = [(name, spec.get("role"), json.dumps(spec, sort_keys=True)) for name, spec in sorted(yaml.safe_load(text).items())]
    return spark.createDataFrame(rows, "name string, role string, spec string")


def pinned(spark: SparkSession, path: str, kind: str, sha256: str | None = None, rows: int | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """A Parquet or JSON source, with its digest, number of rows and columns checked first."""
    if sha256:
        if [r.sha256 for r in _digests(spark.read.format("binaryFile").load(path)).take(2)] != [sha256]:
            raise ValueError(f"{path} has another digest")
    out = getattr(spark.read, kind)(path)
    if absent := checks.absent_columns(out, *columns):
        raise ValueError(f"{path} lacks {absent}")
    if rows is not None:
        checks.require(checks.wrong_count(out, rows), path)
    return out


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Sources of one record type, missing columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _parsed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per line that is not blank: the parsed record r (with the line itself in CORRUPT where it does not parse),
    its file, and its place in the file."""
    whole = T.StructType.fromDDL(schema).add(CORRUPT, T.StringType())
    text = spark.read.text(path).filter(F.trim("value") != "")
    record = F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return text.select(record.alias("r"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))


def json_lines(spark: SparkSession, path: str, schema: str, repair_tail: bool = False) -> DataFrame:
    """Rows of JSON line files. A corrupt line is an error, except (with repair_tail) one at the end of its file: a writer
    was cut off there. Lines are told apart by their place, so a file may be read in parts."""
    rows = _parsed(spark, path, schema)
    bad = rows.filter(F.col(f"r.{CORRUPT}").isNotNull()).select("file", "start", "line")
    if repair_tail:
        last = rows.groupBy("file").agg(F.max(F.struct("start", "line")).alias("last")).select("file", "last.start", "last.line")
        bad = bad.join(last, ["file", "start", "line"], "left_anti")
    if corrupt := bad.count():
        raise ValueError(f"{corrupt} corrupt lines before the end of a file")
    return rows.filter(F.col(f"r.{CORRUPT}").isNull()).select("r.*").drop(CORRUPT)


def recovered(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and a count of kept and corrupt lines by file."""
    rows = _parsed(spark, path, schema)
    corrupt = F.col(f"r.{CORRUPT}").isNotNull()
    counts = rows.groupBy("file").agg(F.count_if(~corrupt).alias("kept"), F.count_if(corrupt).alias("corrupt"))
    return rows.filter(~corrupt).select("r.*").drop(CORRUPT), counts


def discovered(spark: SparkSession, root: str, pattern: str, most_bytes: int) -> DataFrame:
    """Files below a folder by name pattern and size, with their digests."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return _digests(files.filter(F.col("length") <= most_bytes))


def _file_digest(path: str) -> str:
    """SHA-256 of a file of any size, read in pieces."""
    import hashlib

    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    digest = hashlib.sha256()
    with store.open_input_stream(inside) as stream:
        while piece := stream.read(8 << 20):
            digest.update(piece)
    return digest.hexdigest()


def _digests(files: DataFrame) -> DataFrame:
    """(path, length, sha256) of listed files. The content column is never read, so no file has to fit into one row."""

    def digests(paths: pd.Series) -> pd.Series:
        return paths.map(_file_digest)

    return files.select("path", "length").select("path", "length", F.pandas_udf(digests, "string")("path").alias("sha256"))


def step_log_profile(lines: DataFrame, by: str, text: str) -> DataFrame:
    """Per log: records, malformed lines, least and most step, repeated steps and the flattened names of all fields.

    lines: a log's name and one JSON text a row. Names are collected as a set of distinct ones."""
    parsed = lines.select(by, F.try_parse_json(text).alias("v"), F.get_json_object(text, "$.step").cast("long").alias("step"))
    numbers = parsed.groupBy(by).agg(
        F.count_if(F.col("v").isNotNull()).alias("records"), F.count_if(F.col("v").isNull()).alias("malformed"), F.min("step").alias("first_step"), F.max("step").alias("last_step"),
        (F.count("step") - F.count_distinct("step")).alias("repeated_steps"),
    )
    entries = F.map_entries(F.from_json(F.col(text), "map<string,string>"))
    inner = lambda e: F.transform(F.json_object_keys(e["value"]), lambda x: F.concat(e["key"], F.lit("."), x))
    names = F.flatten(F.transform(entries, lambda e: F.coalesce(inner(e), F.array(e["key"]))))
    flat = lines.select(by, names.alias("names"))
    fields = flat.select(by, F.explode("names").alias("n")).groupBy(by).agg(F.array_join(F.sort_array(F.collect_set("n")), ",").alias("fields"))
    return numbers.join(fields, by, "left")


def write_split(tagged: DataFrame, kept: str, removed: str, reason: str = "reason") -> None:
    """Kept and removed rows as two zstd Parquet tables, read back and held against the input."""
    for path, rows in ((kept, tagged.filter(F.col(reason).isNull())), (removed, tagged.filter(F.col(reason).isNotNull()))):
        rows.write.option("compression", "zstd").mode("errorifexists").parquet(path)
    spark = tagged.sparkSession
    checks.require(checks.differences(tagged, spark.read.parquet(kept).unionByName(spark.read.parquet(removed))), "the split is not lossless")


def write_shards(rows: DataFrame, path: str, order: str, most: int) -> None:
    """Shards of at most so many rows, in ranges of the order."""
    rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).write.option("maxRecordsPerFile", most).option("compression", "zstd").parquet(path)


def write_csv(frames: list[DataFrame], path: str) -> None:
    """Rows of several tables with the union of their columns."""
    union_all(frames).write.option("header", "true").csv(path)


def manifest(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Digest and size of every file below the paths: the marker that a consumer checks before it reads."""
    return _digests(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths))


def manifest_violations(spark: SparkSession, marker: DataFrame, paths: list[str]) -> DataFrame:
    """Files that are missing, new or changed since the manifest was written."""
    now = manifest(spark, paths)
    return marker.join(now.select("path", F.col("sha256").alias("_now")), "path", "full_outer").filter(~F.col("sha256").eqNullSafe(F.col("_now"))).select("path")


def markdown(rows: DataFrame, most: int = 200) -> str:
    """A small table as Markdown; a larger one is an error rather than a cut."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join([f"| {' | '.join(rows.columns)} |", f"|{' --- |' * len(rows.columns)}", *[f"| {' | '.join(map(cell, r))} |" for r in found]])


def shard_names(names: list[str]) -> list[str]:
    """The shards of one train split in order; a missing, repeated or foreign one is an error. Names come from a listing."""
    found = {}
    for name in names:
        if not (m := re.fullmatch(r"(?:.*/)?train-(\d{5})-of-(\d{5})\.parquet", name)) or (int(m[1]), int(m[2])) in found:
            raise ValueError(f"not a shard of the split: {name}")
        found[int(m[1]), int(m[2])] = name
    totals = {t for _, t in found}
    if len(totals) != 1 or sorted(i for i, _ in found) != list(range(totals.pop())):
        raise ValueError("the shards are not complete")
    return [found[k] for k in sorted(found)]


ship(__name__)

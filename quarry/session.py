"""Session factory and the two services every operator shares: scratch tables and shipping of Python code."""

from __future__ import annotations

import functools
import gc
import importlib
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "quarry", cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; only Spark opens the path, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_scratch() -> str:
    return "file://" + tempfile.mkdtemp(prefix="quarry-")


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for cut lineage. Where it is unset, a temporary folder stands in on one machine (a local
    master); on a cluster that is an error, since executors would each write to a disk of their own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    return _own_scratch()


def cut(df: DataFrame, *sort: str) -> DataFrame:
    """Write df as a table in the shared scratch folder and read it back: the result has no lineage, survives lost
    executors, is columnar, and is computed once."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/quarry/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames made by cut() that nothing will read again."""
    for df in frames:
        if path := getattr(df, "_quarry_path", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of results that are done with: it does so once the driver collects its garbage,
    which a driver with little to do may put off for half an hour."""
    gc.collect()
    spark._jvm.System.gc()


def ship(module: str) -> None:
    """Pickle the named module's functions by value, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(importlib.import_module(module))


def default_parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session, at least one."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import checks
from quarry.sources import tables
from quarry.streaming import journal

SCHEMA = "id long, status string, attempt long"


def lines(path, rows, tail=""):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows) + tail)
    return str(path)


ROWS = [{"id": i % 4, "status": ["api_error", "complete"][i % 2], "attempt": i} for i in range(10)]


def test_json_lines(spark, tmp_path):
    assert tables.json_lines(spark, lines(tmp_path / "a.jsonl", ROWS), SCHEMA).count() == 10
    torn = lines(tmp_path / "b.jsonl", ROWS, '{"id": 3, "sta')
    assert tables.json_lines(spark, torn, SCHEMA, repair_tail=True).count() == 10
    with pytest.raises(ValueError):
        tables.json_lines(spark, torn, SCHEMA)
    inner = lines(tmp_path / "c.jsonl", ROWS[:3], "{broken\n" + json.dumps(ROWS[0]) + "\n")
    with pytest.raises(ValueError):
        tables.json_lines(spark, inner, SCHEMA, repair_tail=True)
    good, counts = tables.recovered(spark, inner, SCHEMA)
    assert good.count() == 4 and [tuple(r)[1:] for r in counts.collect()] == [(4, 1)]


def test_pinned_registry_discovered(spark, tmp_path):
    path = lines(tmp_path / "a.jsonl", ROWS)
    digest = hashlib.sha256((tmp_path / "a.jsonl").read_bytes()).hexdigest()
    assert tables.pinned(spark, path, "json", digest, 10, ("id",)).count() == 10
    for bad in ({"sha256": "0"}, {"rows": 9}, {"columns": ("nope",)}):
        with pytest.raises(ValueError):
            tables.pinned(spark, path, "json", **bad)
    (tmp_path / "r.yaml").write_text("a: {role: train, rows: 3}\nb: {role: eval}\n")
    assert [(r.name, r.role) for r in tables.registry(spark, str(tmp_path / "r.yaml")).collect()] == [("a", "train"), ("b", "eval")]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/x.jsonl").write_text("x" * 5000)
    found = tables.discovered(spark, str(tmp_path), "*.jsonl", 4000).collect()
    assert [r.sha256 for r in found] == [digest]


def test_writers(spark, tmp_path):
    rows = spark.range(20).withColumn("reason", F.when(F.col("id") % 3 == 0, "x"))
    tables.write_split(rows, str(tmp_path / "k"), str(tmp_path / "r"))
    found = tables.manifest(spark, [str(tmp_path / "k")])
    marker = spark.createDataFrame(found.collect(), found.schema)
    assert marker.count() and tables.manifest_violations(spark, marker, [str(tmp_path / "k")]).count() == 0
    spark.range(1).write.parquet(str(tmp_path / "k/more"))
    assert tables.manifest_violations(spark, marker, [str(tmp_path / "k")]).count() > 0
    tables.write_shards(rows, str(tmp_path / "s"), "id", 4)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 20
    tables.write_csv([rows, spark.range(2).withColumn("z", F.lit(1))], str(tmp_path / "c"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).columns == ["id", "reason", "z"]
    assert tables.markdown(spark.range(2).withColumn("v", F.lit(0.5))) == "| id | v |\n| --- | --- |\n| 0 | 0.50 |\n| 1 | 0.50 |"
    with pytest.raises(ValueError):
        tables.markdown(spark.range(5), 3)


def test_step_log(spark):
    frame = spark.createDataFrame([("a", '{"step": 1, "m": {"x": 1, "y": 2}}'), ("a", '{"step": 1, "loss": 2}'), ("a", "torn {")], "log string, line string")
    (row,) = tables.step_log_profile(frame, "log", "line").collect()
    assert row.asDict() == {"log": "a", "records": 2, "malformed": 1, "first_step": 1, "last_step": 1, "repeated_steps": 1, "fields": "loss,m.x,m.y,step"}


def test_stream_equals_batch_and_resumes(spark, tmp_path):
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    source.mkdir()
    tag = lambda rows: rows.withColumn("reason", F.when(F.col("status") != "complete", F.col("status")))
    for n in range(3):
        lines(source / f"{n}.json", [r | {"attempt": r["attempt"] + 10 * n} for r in ROWS])
        journal.filtered_to(journal.read_stream(spark, str(source), SCHEMA), tag, out, mark)
        whole = tag(spark.read.schema(SCHEMA).json(str(source)))
        done = spark.read.parquet(out)
        assert checks.differences(whole, done.select(whole.columns)).count() == 0
        assert done.filter("kind = 'kept'").count() == whole.filter("reason IS NULL").count()
    last = journal.latest_status(spark.read.schema(SCHEMA).json(str(source)), "id", "attempt")
    assert {r.id: r.attempt for r in last.collect()} == {0: 28, 1: 29, 2: 26, 3: 27}
    assert {r.id for r in journal.to_retry(last, "status").collect()} == {0, 2}


def test_windowed_stream(spark, tmp_path):
    rows = [{"ts": f"2024-01-01T0{h}:30:00", "k": "a"} for h in (1, 1, 2, 5)]
    lines(tmp_path / "x.json", rows)
    stream = journal.read_stream(spark, str(tmp_path), "ts timestamp, k string")
    q = journal.windowed_counts(stream, "ts", "k").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((str(r.start)[11:13], r.n) for r in spark.table("w").collect()) == [("01", 2), ("02", 1), ("05", 1)]


def test_shard_names():
    names = ["d/train-00001-of-00002.parquet", "d/train-00000-of-00002.parquet"]
    assert tables.shard_names(names) == names[::-1]
    for bad in (names[:1], [*names, names[0]], ["x.parquet"], []):
        with pytest.raises((ValueError, KeyError)):
            tables.shard_names(bad)

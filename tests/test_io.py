import gzip
import json

import pytest
from pyspark.sql import functions as F

from sketchmill.operators import curate
from sketchmill.sources import readers, sinks
from sketchmill.streaming import incremental


def test_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x;1\ry\nz;2\n")
    with gzip.open(tmp_path / "b.gz", "wt") as f:
        f.write("k;3\n")
    got = readers.read_lines(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.gz"))
    assert sorted(r["value"] for r in got.collect()) == ["k;3", "x;1\ry", "z;2"]
    with pytest.raises(FileNotFoundError):
        readers.read_lines(spark, str(tmp_path / "none"))


def test_diagrams_and_batches(spark, tmp_path):
    for b in ("batch_0001", "batch_0002"):
        (tmp_path / b).mkdir()
        (tmp_path / b / f"{b}.puml").write_bytes(b"a\r\nb\xff")
    assert {(r["batch"], r["content"]) for r in readers.read_batches(spark, str(tmp_path)).collect()} == {("batch_0001", "a\nb"), ("batch_0002", "a\nb")}
    assert readers.read_diagrams(spark, str(tmp_path / "batch_0001"), "replace").first()["content"] == "a\nb�"


def test_reports(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"results": {"a": {"n": 1}, "b": {"n": 2}}}, indent=1))
    rows = readers.read_report(spark, str(tmp_path / "r.json"), "results", "struct<n:int>")
    assert sorted(map(tuple, rows.collect())) == [("a", 1), ("b", 2)]
    assert json.loads(sinks.report_json(rows, "file_name", "n").first()["value"]) == {"a": {"n": 1}, "b": {"n": 2}}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("valid", "b1", "p", "x;y\n", None), ("invalid", "b2", "p", "z", "missing @enduml"), ("error", "b3", "p", None, "Blob not found")], "status string, blob_id string, file_path string, content string, reason string")
    sinks.write_routed(rows, str(tmp_path / "out"))
    got = spark.read.text(str(tmp_path / "out"))
    assert {(r["status"], r["value"]) for r in got.collect()} == {("valid", "b1;p;eDt5Cg=="), ("invalid", "b2;p;missing @enduml"), ("error", "b3;p;Blob not found")}
    text = sinks.diagram_file(sinks.long_header(F.lit("b"), F.lit("p"), "archive"), F.lit("x"))
    files = spark.range(1).select(F.lit("batch_0001").alias("directory"), F.lit("a.puml").alias("file_name"), text.alias("content"))
    assert sinks.write_diagrams(files.unionByName(spark.range(1).select(F.lit(None).cast("string").alias("directory"), F.lit("b.puml").alias("file_name"), F.lit("é").alias("content"))), str(tmp_path / "files")) == 2
    assert (tmp_path / "files/batch_0001/a.puml").read_text() == "' Blob ID: b\n' Original Path: p\n' Source: archive\n\nx\n"
    assert (tmp_path / "files/b.puml").read_text() == "é"
    with pytest.raises(Exception, match="not a name"):
        sinks.write_diagrams(files.withColumn("file_name", F.lit("../x")), str(tmp_path / "files"))


def test_input_order(spark, tmp_path):
    """Lines keep their place in their files, so the first of a key in input order can be asked for, and lines be numbered."""
    for name, n in (("a", 700), ("b", 300)):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{k};v\n" for k in range(n)) + "same;%s\n" % name)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = readers.read_lines(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.txt"))
        numbered = {r["value"]: r["line_no"] for r in readers.with_line_numbers(lines).collect() if r["value"] != "same;b"}
        want = [f"a{k};v" for k in range(700)] + ["same;a"] + [f"b{k};v" for k in range(300)]
        assert numbered == {v: k + 1 for k, v in enumerate(want)}
        firsts = curate.first_by_key(curate.path_records(lines), "blob_id", *readers.INPUT_ORDER)
        assert {r["blob_id"]: r["file_path"] for r in firsts.collect()}["same"] == "a"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_bounded_reports_and_strict_text(spark, tmp_path):
    rows = spark.range(3).select(F.col("id").cast("string").alias("k"), "id")
    with pytest.raises(ValueError):
        sinks.report_json(rows, "k", "id", most=2)
    got = json.loads(sinks.report_envelope(rows, "k", ("id",), {"version": "1"}, rows.agg(F.count("*").alias("n"))).first()["value"])
    assert got == {"metadata": {"version": "1"}, "statistics": {"n": 3}, "results": {str(k): {"id": k} for k in range(3)}}
    (tmp_path / "x.puml").write_bytes(b"a\xff")
    with pytest.raises(Exception, match="UTF8|utf8|UTF-8"):
        readers.read_diagrams(spark, str(tmp_path), "strict").collect()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("b1;a.puml\nb2;b.txt\nbad\n")
    q = incremental.select_paths(incremental.stream_lines(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("picked").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("select * from picked").collect()] == [("b1", "a.puml")]


def test_stream_dedup_and_windows(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:01:00"), ("b", "2024-01-01 00:20:00")], "k string, t string").withColumn("t", F.to_timestamp("t"))
    rows.write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "p"))
    for name, frame in (("firsts", incremental.dedup_stream(stream, "k", "t")), ("counts", incremental.counts_by_window(stream, "t", "10 minutes", "k"))):
        mode = "append" if name == "firsts" else "complete"
        q = frame.writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r["k"] for r in spark.sql("select * from firsts").collect()) == ["a", "b"]
    assert sorted((r["k"], r["n"]) for r in spark.sql("select * from counts").collect()) == [("a", 2), ("b", 1)]

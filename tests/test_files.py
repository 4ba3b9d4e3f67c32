"""The writer of files: what is visible, when, and what failed attempts leave."""

import gzip
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sketchmill.sources import files


def batch(*rows):
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["directory", "file_name", "value"])


def tree(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)


def failing(*batches):
    yield from batches
    raise RuntimeError("lost")


def test_a_failed_and_retried_task_leaves_nothing(tmp_path):
    out = tmp_path / "out"
    writer = files.TextFilesWriter({"path": str(out), "compression": '{"a": "gzip"}'})
    rows = batch(("a", None, "x"), ("b", None, "é"), ("c", "f.puml", "whole\n"), (None, "top.txt", "t"))
    with pytest.raises(RuntimeError):
        writer.write(failing(rows))
    good, twice = writer.write(iter([rows, batch(("a", None, None))])), writer.write(iter([rows]))  # one attempt ends, but Spark counts the other
    other = writer.write(iter([batch(("b", None, "second task"), ("c", "g.puml", ""))]))
    assert all(x.startswith("_staging/") for x in tree(out))  # nothing is visible before the commit
    assert twice.attempt != good.attempt
    writer.commit([good, other, None])
    got = tree(out)
    assert "_SUCCESS" in got and not any("_staging" in x for x in got) and not (out / "_staging").exists()
    assert {x for x in got if "part-" not in x} == {"_SUCCESS", "c/f.puml", "c/g.puml", "top.txt"}
    parts = {k: [x for x in got if x.startswith(f"{k}/part-")] for k in "ab"}
    assert len(parts["a"]) == 1 and gzip.open(out / parts["a"][0]).read() == b"x\n\n"
    assert sorted((out / x).read_text() for x in parts["b"]) == ["second task\n", "é\n"]


def test_an_aborted_job_leaves_nothing(spark, tmp_path):
    writer = files.TextFilesWriter({"path": str(tmp_path / "out")})
    done = writer.write(iter([batch(("a", None, "x"))]))
    writer.abort([done, None])
    assert tree(tmp_path / "out") == []
    rows = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise("d").alias("d"), F.col("id").cast("string").alias("v"))
    with pytest.raises(Exception, match="no"):
        files.write_files(rows.repartition(4), str(tmp_path / "failed"), F.col("d"), F.lit(None), F.col("v"))
    assert tree(tmp_path / "failed") == []


def test_many_tasks_and_directories(spark, tmp_path):
    n = 3000
    rows = spark.range(n).repartition(7)
    d = F.concat(F.lit("d"), (F.col("id") % 5).cast("string"))
    assert files.write_files(rows, f"file://{tmp_path}/out", d, F.when(F.col("id") % 100 == 0, F.concat("id", F.lit(".txt"))), F.col("id").cast("string"), {"d1": "gzip"}) == n
    lines = spark.read.text(str(tmp_path / "out"), recursiveFileLookup=True)
    assert sorted(int(r["value"]) for r in lines.collect()) == list(range(n))
    with pytest.raises(FileExistsError):
        files.write_files(rows, f"file://{tmp_path}/out", d, F.lit(None), F.lit("x"))
    assert files.write_files(rows.limit(0), str(tmp_path / "none"), d, F.lit(None), F.lit("x")) == 0 and tree(tmp_path / "none") == ["_SUCCESS"]

"""The scan over lines against splitting a file in its row."""

import random

import pytest
from pyspark.sql import functions as F

from sketchmill.operators import blocks, scan


def made(seed, files=12):
    draw = random.Random(seed)
    kinds = ["@startuml", "  @StartJson x", "@enduml", "\t@END", "text", "a @startuml", "' comment", "", "  ", "@", "@star"]
    return {f"f{k}": [draw.choice(["", "' c", "  ' d"]) for _ in range(draw.randint(0, 3))] + [draw.choice(kinds) for _ in range(draw.choice([0, 1, 5, 60, 300]))] for k in range(files)}


def expected(spark, files):
    rows = [(k, "".join(x + "\n" for x in lines)) for k, lines in files.items() if lines]
    got = blocks.split_files(spark.createDataFrame(rows, "stem string, content string")).collect()
    return {(r["stem"], r["part"]): r["content"] for r in got}


@pytest.mark.parametrize("chunk,parts,cells", [(1, 3, 10**6), (3, 7, 10**6), (50, 2, 0), (10**6, 5, 10**6)])
def test_equals_splitting_in_a_row(spark, monkeypatch, chunk, parts, cells):
    monkeypatch.setattr(scan, "BROADCAST_CELLS", cells)
    monkeypatch.setattr(scan, "CELL", 5)
    files = made(chunk)
    rows = [(k, 10 * n + 7, x) for k, lines in files.items() for n, x in enumerate(lines)]  # numbers with gaps
    random.Random(1).shuffle(rows)
    lines = spark.createDataFrame(rows, "stem string, line_no long, value string").repartition(parts)
    got: dict = {}
    for r in sorted(scan.split_lines(lines, chunk=chunk).collect(), key=lambda r: r["line_no"]):
        got[r["stem"], r["part"]] = got.get((r["stem"], r["part"]), "") + r["value"] + "\n"
    assert got == expected(spark, files)


def test_null_names_and_no_lines(spark):
    rows = [(None, 1, "@startuml"), (None, 2, "x"), (None, 3, "@enduml"), ("a", 1, None), ("a", 2, "@enduml")]
    lines = spark.createDataFrame(rows, "stem string, line_no long, value string")
    assert [tuple(r) for r in scan.block_spans(lines).collect()] == [(None, 1, 1, 3)]
    assert scan.block_spans(lines.limit(0)).count() == 0 and scan.split_lines(lines.limit(0)).count() == 0
    assert {(r["stem"], r["line_no"]): r["part"] for r in scan.label_lines(lines, scan.block_spans(lines)).collect()} == {(None, 1): 1, (None, 2): 1, (None, 3): 1, ("a", 1): None, ("a", 2): None}


def test_one_long_file(spark):
    """A file of two million lines is dealt over its chunks: no task of the scan has more than a chunk's marks."""
    n = 2_000_000
    value = F.when(F.col("id") % 10 == 0, "@startuml").when(F.col("id") % 10 == 6, "@enduml").otherwise(F.concat(F.lit("line "), F.col("id").cast("string")))
    lines = spark.range(n).select(F.lit("big").alias("stem"), F.col("id").alias("line_no"), value.alias("value"))
    spans = scan.block_spans(lines)
    got = spans.agg(F.count("*"), F.max("part"), F.min(F.col("last_line") - F.col("first_line")), F.max(F.col("last_line") - F.col("first_line")), F.sum(F.col("part") * 10 - 10 - F.col("first_line"))).first()
    assert tuple(got) == (n // 10, n // 10, 6, 6, 0)
    assert scan.marks(lines).groupBy("chunk").count().agg(F.max("count")).first()[0] == scan.CHUNK // 5

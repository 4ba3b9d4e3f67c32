"""Readers of line files, diagram folders and JSON reports. All paths go through Spark's own readers, so any store will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import universal_newlines, utf8


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """value, shard, block, position: lines end at \\n only; gzip files are opened as such (one task a file). A missing path is an error, before any work."""
    missing = [p for p in paths if not path_exists(spark, p)]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    rows = spark.read.option("lineSep", "\n").text(list(paths))
    return rows.select("value", F.col("_metadata.file_path").alias("shard"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("position"))


#: The order of read_lines' rows in their files: shards by name, blocks of a shard, lines of a block (a task reads a block from its start).
INPUT_ORDER = ("shard", "block", "position")


def with_line_numbers(lines: DataFrame, *order: str) -> DataFrame:
    """line_no long from 1, over all rows in the given order (INPUT_ORDER if none); see operators.curate.assign_batches for how it is counted."""
    from ..operators.curate import assign_batches

    return assign_batches(lines, 1, *(order or INPUT_ORDER), number="line_no").drop("directory")


def read_diagrams(spark: SparkSession, path: str, errors: str = "ignore", recursive: bool = False, pattern: str = "*.puml") -> DataFrame:
    """file_name, path, content: whole files, bad bytes dropped, replaced or (strict) an error, line ends as \\n."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select(name.alias("file_name"), "path", universal_newlines(utf8(F.col("content"), errors)).alias("content"))


def read_batches(spark: SparkSession, root: str, errors: str = "ignore") -> DataFrame:
    """Diagrams of the batch_* folders below root (with batch, the folder's name), or of root itself where there is none."""
    nested = f"{root.rstrip('/')}/batch_*"
    path = nested if path_exists(spark, nested) else root
    batch = F.regexp_extract("path", r"/(batch_[^/]*)/[^/]*\z", 1)
    return read_diagrams(spark, path, errors).withColumn("batch", F.when(batch != "", batch))


def list_paths(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path of every file; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path")


def read_report(spark: SparkSession, path: str, field: str, value_schema: str) -> DataFrame:
    """A JSON document whose `field` maps names to structs -> file_name and the struct's fields."""
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", f"struct<`{field}`: map<string, {value_schema}>>")
    return text.select(F.explode(entries[field]).alias("file_name", "r")).select("file_name", "r.*")

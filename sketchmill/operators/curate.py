"""Selection, validation and deduplication of path and content records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import decode_base64, fields, nonempty_lines, strip, utf8
from ..sources.scratch import shared_path
from .stages import once

EXTENSIONS = ("puml", "pu", "plantuml", "wsd", "iuml", "uml")
START, END = "@startuml", "@enduml"
MIN_LINES = 5


def has_diagram_extension(line: Column) -> Column:
    """On the whole `blob;path` line, any case."""
    return line.rlike(rf"(?i)\.({'|'.join(EXTENSIONS)})\z")


def path_records(lines: DataFrame) -> DataFrame:
    """value -> blob_id, file_path; blank lines and lines without two fields are left out."""
    f = fields(strip(F.col("value")), 2)
    return lines.where(F.size(f) == 2).where(strip(F.col("value")) != "").select(f[0].alias("blob_id"), f[1].alias("file_path"), *[c for c in lines.columns if c != "value"])


def missing_markers(content: Column) -> Column:
    """The missing markers, joined by ', '; empty if both are there."""
    none = [~F.contains(F.lower(content), F.lit(x)) for x in (START, END)]
    return F.concat_ws(", ", *[F.when(absent, f"missing {x}") for absent, x in zip(none, (START, END))])


def extraction_outcome(content: Column) -> Column:
    """struct<status, reason>: valid, invalid (missing markers) or error (not found, empty)."""
    return _outcome(content, missing_markers(content))


def _outcome(content: Column, missing: Column) -> Column:
    status = F.when(content.isNull() | (content == ""), "error").when(missing == "", "valid").otherwise("invalid")
    reason = F.when(content.isNull(), "Blob not found").when(content == "", "Empty content").when(missing == "", F.lit(None).cast("string")).otherwise(missing)
    return F.struct(status.alias("status"), reason.alias("reason"))


def lookup_content(records: DataFrame, contents: DataFrame) -> DataFrame:
    """Left join by blob_id with the outcome of each record; a blob without content is an error row."""
    found = records.join(contents.select("blob_id", "content"), "blob_id", "left").withColumn("_missing", missing_markers(F.col("content")))
    return found.withColumn("outcome", _outcome(F.col("content"), F.col("_missing"))).select("*", "outcome.*").drop("outcome", "_missing")


def is_blob_id(c: Column) -> Column:
    return c.rlike(r"\A[0-9a-fA-F]{40}\z")


def content_records(lines: DataFrame) -> DataFrame:
    """value (`blob;path;base64`), line_no -> blob_id, file_path, content, reason: the first reason that fails, or null.

    Reasons in order: malformed line, invalid blob id, bad base64, missing markers.
    """
    # each step is a column of its own that later steps use several times, so that none is computed twice
    rows = lines.withColumn("_f", fields(strip(F.col("value")), 3))
    rows = rows.withColumn("content", utf8(decode_base64(F.get("_f", F.lit(2))), "ignore"))
    rows = rows.withColumn("_missing", missing_markers(F.col("content")))
    at = F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": "))
    reason = (
        F.when(F.size("_f") < 3, F.concat(at, F.lit("malformed line")))
        .when(~is_blob_id(F.get("_f", F.lit(0))), F.concat(at, F.lit("invalid blob id")))
        .when(F.col("content").isNull(), F.concat(at, F.lit("bad base64")))
        .when(F.col("_missing") != "", F.concat(at, "_missing"))
    )
    return rows.select(*lines.columns, F.get("_f", F.lit(0)).alias("blob_id"), F.get("_f", F.lit(1)).alias("file_path"), "content", reason.alias("reason"))


def first_by_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key: the first in the given order. A minimum, not a window, so it is summed up before the shuffle and needs no sort."""
    rest = [c for c in rows.columns if c != key and c not in order]
    least = rows.groupBy(key).agg(F.min(F.struct(*order, *rest)).alias("r"))
    return least.select(key, *[F.col(f"r.{c}").alias(c) for c in (*order, *rest)])


def content_duplicates(rows: DataFrame, column: str = "content") -> DataFrame:
    """sha1 of the content, rows that share it."""
    return rows.groupBy(F.sha1(F.col(column).cast("binary")).alias("content_sha1")).agg(F.count("*").alias("n"))


def git_blob_id(content: Column) -> Column:
    """The object id that git gives these bytes."""
    raw = content.cast("binary")
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(raw).cast("string")).cast("binary"), F.unhex(F.lit("00")), raw))


def join_projects(records: DataFrame, projects: DataFrame) -> DataFrame:
    return records.join(projects, "blob_id", "inner")


def length_filter(rows: DataFrame, column: str = "content", min_lines: int = MIN_LINES) -> DataFrame:
    return once(rows.withColumn("n_lines", nonempty_lines(F.col(column))), "n_lines").where(F.col("n_lines") >= min_lines)


def first_directory_hit(files: DataFrame, name: str = "file_name", priority: str = "priority", column: str = "content") -> DataFrame:
    """Of files of one name in several directories, the one of the directory that comes first."""
    return files.groupBy(name).agg(F.min_by(column, priority).alias(column), F.min(priority).alias(priority))


def assign_batches(rows: DataFrame, size: int, *order: str, number: str = "batch") -> DataFrame:
    """batch int from 1 and its directory name, by the running ordinal over all rows in order; rows that tie go by a hash of all columns.

    The ordinal is counted in two steps, so no task sees all rows: rows are range-partitioned by the order, sorted in their partitions and
    written to the shared folder with their place; the partitions' sizes (one small row each) then say where each begins. Rows are stored
    before that, so that what makes them runs once for the sample of the ranges and for the rows, and so that their size is known.
    """
    spark = rows.sparkSession
    first = shared_path(spark, "unordered-rows")
    rows.write.parquet(first)
    stored = spark.read.parquet(first)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), stored.rdd.getNumPartitions())  # of a plain scan: grows with its bytes
    keyed = stored.withColumn("_tie", F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))
    spread = keyed.repartitionByRange(parts, *[F.col(c) for c in order], F.col("_tie")).sortWithinPartitions(*order, "_tie")
    path = shared_path(spark, "ordered-rows")
    spread.drop("_tie").withColumn("_place", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path)
    part = F.shiftright("_place", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(part.alias("_part")).count()
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    at = F.col("_base") + F.col("_place") - F.shiftleft("_part", 33)
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(number, (F.floor(at / size) + 1).cast("long" if size == 1 else "int"))  # offsets: a row a partition
    return numbered.withColumn("directory", F.format_string("batch_%04d", number)).drop("_part", "_place", "_base")


def sanitize_path(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, r"\A/+", ""), "/\\:", "___")


def sanitize_id(name: Column) -> Column:
    return F.substring(F.regexp_replace(F.replace(name, F.lit(".puml"), F.lit("")), "[^A-Za-z0-9_-]", "_"), 1, 64)


def id_map(names: DataFrame, name: str = "file_name", order: str = "ord") -> DataFrame:
    """custom_id -> file name; of names that collide the last in order wins."""
    return names.groupBy(sanitize_id(F.col(name)).alias("custom_id")).agg(F.max_by(name, order).alias(name))


def back_map(results: DataFrame, ids: DataFrame) -> DataFrame:
    """Results by custom_id with their file name; unknown ids get the id with '.puml'."""
    return results.join(ids, "custom_id", "left").withColumn("file_name", F.coalesce("file_name", F.concat("custom_id", F.lit(".puml"))))


def not_submitted(batches: DataFrame, done: DataFrame, key: str = "batch") -> DataFrame:
    return batches.join(done.select(key).distinct(), key, "left_anti")

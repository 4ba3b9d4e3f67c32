"""Writers: routed text, one file a diagram, JSON reports. Rows stay distributed; reports are single rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import encode_base64
from .files import write_files


def content_line(blob: Column, path: Column, content: Column) -> Column:
    """`blob;path;base64`, on one line."""
    return F.concat_ws(";", blob, path, encode_base64(content))


def write_routed(outcomes: DataFrame, path: str) -> int:
    """status, blob_id, file_path, content, reason -> text folders status=valid (gzip), status=invalid and status=error, all in one pass; they
    become visible together (sources.files). Gives the number of rows."""
    known = outcomes.where(F.col("status").isin("valid", "invalid", "error"))
    line = F.when(F.col("status") == "valid", content_line(F.col("blob_id"), F.col("file_path"), F.col("content"))).otherwise(F.concat_ws(";", "blob_id", "file_path", F.coalesce("reason", F.lit(""))))
    return write_files(known, path, F.concat(F.lit("status="), "status"), F.lit(None), line, {"status=valid": "gzip"})


def short_header(blob: Column, path: Column) -> Column:
    return F.concat(F.lit("' Blob ID: "), blob, F.lit("\n' File Path: "), path, F.lit("\n' \n"))


def long_header(blob: Column, path: Column, source: str) -> Column:
    """Four lines; `source` names where the content came from."""
    return F.concat(F.lit("' Blob ID: "), blob, F.lit("\n' Original Path: "), path, F.lit(f"\n' Source: {source}\n\n"))


def diagram_file(header: Column, content: Column) -> Column:
    """Header and content; ends with a line end."""
    return F.concat(header, content, F.when(content.endswith("\n"), "").otherwise("\n"))


def write_diagrams(files: DataFrame, path: str) -> int:
    """directory, file_name, content -> the file `path/directory/file_name` of each row (a null directory: right below path), and returns how
    many were written. They become visible together (sources.files). One file a diagram is for export only; tables are stored as Parquet."""
    named = F.when(F.col("file_name").isNull(), F.raise_error(F.lit("a diagram without a file name"))).otherwise(F.col("file_name"))
    return write_files(files, path, F.col("directory"), named, F.col("content"), fresh=False)


#: Rows that a JSON report may hold: it is one row of one task.
REPORT_ROWS = 1_000_000


def report_json(rows: DataFrame, key: str, *fields: str, most: int = REPORT_ROWS) -> DataFrame:
    """One row `value`: a JSON object of the rows' structs by key. Reports are bounded: more than `most` rows are an error, to be stored as
    Parquet."""
    return _checked(rows, most).agg(F.to_json(_by_key(key, fields)).alias("value"))


def _by_key(key: str, fields) -> Column:
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.struct(*fields).alias("value")))))


def _checked(rows: DataFrame, most: int) -> DataFrame:
    n = rows.limit(most + 1).count()
    if n > most:
        raise ValueError(f"a report of more than {most} rows")
    return rows


def report_envelope(rows: DataFrame, key: str, fields: tuple[str, ...], metadata: dict[str, str], statistics: DataFrame, section: str = "results", most: int = REPORT_ROWS) -> DataFrame:
    """One row `value`: {"metadata": ..., "statistics": ..., section: {key: struct, ...}}; statistics is a table of one row."""
    made = _checked(rows, most).agg(_by_key(key, fields).alias(section))
    known = F.struct(*[F.lit(v).alias(k) for k, v in metadata.items()]).alias("metadata")
    stats = statistics.select(F.struct(*statistics.columns).alias("statistics"))
    return stats.crossJoin(made).select(F.to_json(F.struct(known, "statistics", section)).alias("value"))  # one row each


def preview(rows: DataFrame, order: str, n: int = 10) -> DataFrame:
    """The first n rows, as a console listing shows them."""
    return rows.orderBy(order).limit(n)


def route_by_image(diagrams: DataFrame, images: DataFrame) -> DataFrame:
    """diagrams with has_image, to be written partitioned by it."""
    from ..operators.images import image_keys

    keys = image_keys(images).withColumn("_hit", F.lit(True))
    return diagrams.join(keys, "stem", "left").withColumn("has_image", F.coalesce("_hit", F.lit(False))).drop("_hit")

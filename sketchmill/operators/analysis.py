"""One record a diagram: its classification with lines of code, elements and relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import loc_metrics, relationships

LOC = ("loc", "total_lines", "blank_lines", "comment_lines")


def with_loc(classified: DataFrame, files: DataFrame) -> DataFrame:
    """classified: file_name, ...; files: file_name, content -> the line metrics of each file; null where it is not found or has no content."""
    joined = classified.join(files.select("file_name", "content"), "file_name", "left").withColumn("_m", F.when(F.col("content").isNotNull(), loc_metrics(F.col("content"))))
    return joined.select(*classified.columns, *[F.col(f"_m.{c}").alias(c) for c in LOC])


def loc_counts(enriched: DataFrame) -> DataFrame:
    """One row: how many records got line metrics (processed) and how many did not (skipped)."""
    return enriched.agg(F.count_if(F.col("loc").isNotNull()).alias("processed"), F.count_if(F.col("loc").isNull()).alias("skipped"))


def _sum(counts: Column) -> Column:
    return F.aggregate(F.map_values(counts), F.lit(0), lambda a, x: a + x)


def merged(element_results: DataFrame, files: DataFrame) -> DataFrame:
    """element_results: file_name, primary_type, elements, total_elements, note, ... ; files: file_name, content -> relationships
    map<category, count> and total_relationships. Files that are not found, or empty, have none; a file that is not found keeps its note."""
    known = files.select("file_name", "content", F.lit(True).alias("_there"))
    joined = element_results.join(known, "file_name", "left").withColumn("relationships", relationships(F.coalesce("content", F.lit("")), F.col("primary_type")))
    note = F.when(F.col("_there").isNull(), F.coalesce("note", F.lit("file not found")))
    return joined.withColumn("total_relationships", _sum(F.col("relationships"))).withColumn("note", note).drop("content", "_there")


def relationship_stats(analysis: DataFrame) -> DataFrame:
    """One row: total_files, files_with_relationships, total_relationships."""
    n = F.col("total_relationships")
    return analysis.agg(F.count("*").alias("total_files"), F.count_if(n > 0).alias("files_with_relationships"), F.coalesce(F.sum(n), F.lit(0)).alias("total_relationships"))

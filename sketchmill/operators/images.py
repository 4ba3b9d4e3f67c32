"""Rendered images: which diagrams have one, and what the render log says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .curate import assign_batches

SUFFIXES = ("png", "jpg", "jpeg", "svg", "gif", "bmp")


def image_stems(paths: DataFrame, column: str = "path") -> DataFrame:
    name = F.element_at(F.split(column, "/"), -1)
    return paths.where(F.lower(name).rlike(rf"\.({'|'.join(SUFFIXES)})\z")).select(F.regexp_replace(name, r"\.[^.]*\z", "").alias("stem"))


def image_keys(images: DataFrame) -> DataFrame:
    """Every stem, and every stem that ends in _ and three digits without them: so that the match is an equi-join."""
    short = F.regexp_extract("stem", r"\A(.*)_[0-9]{3}\z", 1)
    return images.select(F.explode(F.array("stem", F.when(short != "", short))).alias("stem")).where("stem IS NOT NULL").distinct()


def with_image(diagrams: DataFrame, images: DataFrame) -> DataFrame:
    return diagrams.join(image_keys(images), "stem", "left_semi")


def without_image(diagrams: DataFrame, images: DataFrame) -> DataFrame:
    return diagrams.join(image_keys(images), "stem", "left_anti")


def render_stats(log: DataFrame, total: int) -> DataFrame:
    """value lines -> failed (distinct files), valid, percent (whole). The second format counts only where the first finds none."""
    first = F.regexp_extract("value", r"Error line [0-9]+ in file: (.+)\z", 1)
    second = F.regexp_extract("value", r"\A([^:]+\.puml):.*:error:", 1)
    n = log.agg(F.countDistinct(F.when(first != "", first)).alias("a"), F.countDistinct(F.when(second != "", second)).alias("b"))
    failed = F.when(F.col("a") > 0, F.col("a")).otherwise(F.col("b"))
    return n.select(F.lit(total).cast("long").alias("total"), failed.alias("failed"), (F.lit(total) - failed).alias("valid")).withColumn(
        "percent", F.when(F.col("total") > 0, F.expr("valid * 100 div total")).otherwise(F.lit(0).cast("long"))
    )


#: Lines of the rendering report: {} is filled in order (fixed layout).
REPORT = (
    "PlantUML Image Generation Statistics", "=====================================", "", "Timestamp: {timestamp}", "Input directory: {input}", "Output directory: {output}", "", "Summary:",
    "  Total files:       {total}", "  Valid files:       {valid}", "  Failed files:      {failed}", "  Images generated:  {images}", "  Success rate:      {percent}%", "",
    "Processing time: {minutes}m {seconds}s", "",
)
FAILED_LIST = ("Failed files list:", "==================")


def render_report(log: DataFrame, total: int, images: int, source: str, target: str, timestamp: str, took: int) -> DataFrame:
    """ord long, value: the report's lines. The counts are one row; the list of failed files (of the first format alone) stays a table, in the
    order of their names, however long it is."""
    stats = render_stats(log, total)
    known = {"timestamp": F.lit(timestamp), "input": F.lit(source), "output": F.lit(target), "images": F.lit(str(images)), "minutes": F.lit(str(took // 60)), "seconds": F.lit(str(took % 60))}
    filled = known | {c: F.col(c).cast("string") for c in ("total", "valid", "failed", "percent")}

    def line(text: str) -> Column:
        out = F.lit(text)
        for name, value in filled.items():
            out = F.replace(out, F.lit("{" + name + "}"), value) if "{" + name + "}" in text else out
        return out

    head = F.when(F.col("failed") > 0, F.array(*map(line, REPORT + FAILED_LIST))).otherwise(F.array(*map(line, REPORT)))
    top = stats.select(F.posexplode(head).alias("ord", "value")).select(F.col("ord").cast("long").alias("ord"), "value")
    names = log.select(F.regexp_extract("value", r"Error line .* in file: (.+)\z", 1).alias("value")).where("value <> ''").distinct()
    listed = assign_batches(names, 1, "value", number="ord").select((F.col("ord") + len(REPORT + FAILED_LIST) - 1).alias("ord"), "value")
    return top.unionByName(listed)

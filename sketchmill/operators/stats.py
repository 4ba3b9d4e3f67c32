"""Distributions and reports. Ranks come from counts by narrowing intervals (operators.selection), never from sorted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..sources.scratch import shared_path
from . import selection

BUCKETS = (("1-10", 1, 10), ("11-50", 11, 50), ("51-100", 51, 100), ("101-200", 101, 200), ("201+", 201, None))


def status_counts(rows: DataFrame, column: str = "status") -> DataFrame:
    """status, n, pct (of all rows)."""
    n = rows.groupBy(column).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    return n.crossJoin(F.broadcast(total)).select(column, "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"))  # total: one row


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def rank_stats(rows: DataFrame, column: str, places: int | None = None, stored: bool = False) -> DataFrame:
    """One row: n, min, q1, median, q3, max, mean (rounded to so many places, if given); the value of rank n div 4, n div 2, 3 * n div 4
    (from 0). All 0 for no rows. Jobs run at the call: the column alone is written to the shared folder first, so that what makes it runs
    once, unless it is `stored` already; then selection.select_ranks narrows down to the ranks."""
    spark = rows.sparkSession
    values = rows.select(column).where(F.col(column).isNotNull())
    if not stored:
        path = shared_path(spark, "ranked")
        values.write.parquet(path)
        values = spark.read.schema(values.schema).parquet(path)
    kind = "long" if isinstance(values.schema[column].dataType, IntegralType) else "double"
    known = selection.summarize(values, column)
    at = selection.select_ranks(values, column, [known.n // 4, known.n // 2, 3 * known.n // 4, 0, known.n - 1], known) if known.n else [0] * 5
    mean = F.coalesce(F.sum(column) / F.count("*"), F.lit(0.0))
    found = {"n": (known.n, "long"), "min": (at[3], kind), "q1": (at[0], kind), "median": (at[1], kind), "q3": (at[2], kind), "max": (at[4], kind)}
    return values.agg((mean if places is None else F.bround(mean, places)).alias("mean")).select(*[F.lit(v).cast(t).alias(c) for c, (v, t) in found.items()], "mean")


def bucket_of(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, lo, hi in BUCKETS:
        out = F.when((c >= lo) & (c <= hi) if hi else c >= lo, name).otherwise(out)
    return out


def bucket_counts(rows: DataFrame, column: str) -> DataFrame:
    """All buckets, also empty ones; values under 1 are in none."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(k, b[0]) for k, b in enumerate(BUCKETS)], "ord int, bucket string")
    n = rows.groupBy(bucket_of(F.col(column)).alias("bucket")).agg(F.count("*").alias("n"))
    return names.join(n, "bucket", "left").select("ord", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def top_buckets(rows: DataFrame, column: str, k: int = 20, width: int = 50, seen: str | None = None) -> DataFrame:
    """The k commonest values with bars scaled to the commonest; of equals, the one seen first by the column `seen`, or else the smaller."""
    first = F.min(seen) if seen else F.min(column)
    top = rows.groupBy(column).agg(F.count("*").alias("n"), first.alias("_first")).orderBy(F.desc("n"), "_first").limit(k).drop("_first")
    best = top.agg(F.max("n").alias("best"))
    size = F.least(F.lit(width), F.floor(F.col("n") * width / F.col("best")).cast("int"))
    return top.crossJoin(F.broadcast(best)).select(column, "n", F.repeat(F.lit("█"), size).alias("bar"))  # best: one row


def filter_rates(kept: Column, error: Column) -> list[Column]:
    """Aggregates: total, kept, filtered and error counts, with the kept rate (0 for no rows)."""
    total = F.count("*")
    return [total.alias("total"), F.count_if(kept).alias("kept"), F.count_if(~kept & ~error).alias("filtered"), F.count_if(error).alias("errors"), F.when(total > 0, F.count_if(kept) / total).otherwise(0.0).alias("kept_rate")]


def map_totals(rows: DataFrame, column: str, key: str = "type") -> DataFrame:
    """Sums of a map column by key, with the rows that have it."""
    return rows.select(F.explode(column).alias(key, "v")).groupBy(key).agg(F.sum("v").alias("total"), F.count("*").alias("files"))


def complexity(c: Column) -> Column:
    return F.when(c < 10, "Simple").when(c <= 50, "Medium").otherwise("Complex")


def type_profile(rows: DataFrame, kind: str, loc: str) -> DataFrame:
    """By type: n, share of all, mean lines, and how many of each complexity class."""
    total = rows.agg(F.count("*").alias("total"))
    got = rows.groupBy(kind).agg(
        F.count("*").alias("n"), F.avg(loc).alias("avg_loc"), *[F.count_if(complexity(F.col(loc)) == x).alias(x.lower()) for x in ("Simple", "Medium", "Complex")]
    )
    return got.crossJoin(F.broadcast(total)).withColumn("pct", F.col("n") * 100.0 / F.col("total")).drop("total")  # total: one row


def type_complexity_grid(rows: DataFrame, kind: str, loc: str) -> DataFrame:
    return rows.groupBy(kind, complexity(F.col(loc)).alias("complexity")).agg(F.count("*").alias("n"))


def stratified_sample(rows: DataFrame, strata: list[str], key: str, k: int = 30) -> DataFrame:
    """The k rows of each stratum whose keys have the smallest md5: the same whatever the partitions. The rank filter keeps k rows a
    stratum and task before the shuffle."""
    order = Window.partitionBy(*strata).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key)
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")

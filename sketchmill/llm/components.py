"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014), in DataFrame operations.

The minimum of a neighbourhood is an aggregate that is joined back, so no neighbourhood is gathered in one place. Each round is
written to the shared folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize, write_table


def _star(edges: DataFrame) -> DataFrame:
    """edges: u > v. One large-star then one small-star step; again u > v, distinct."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, keep=materialize) -> DataFrame:
    """edges: a long, b long (either order; loops and repeats allowed) -> node, root: the smallest node reachable; nodes without a link are
    left out. keep(df, name) writes the result's table; those of the rounds are removed."""
    spark = edges.sparkSession
    ordered = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    path = write_table(ordered, "edges")
    mark = None
    while True:
        now = spark.read.schema("u long, v long").parquet(path)
        sums = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (sums["n"], sums["s"]) == mark:
            out = keep(now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "components")
            drop_table(spark, path)
            return out
        mark = (sums["n"], sums["s"])
        after = write_table(_star(now), "edges")
        drop_table(spark, path)
        path = after

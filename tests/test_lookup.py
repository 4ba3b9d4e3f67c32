"""The bucketed store and its filter."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from sketchmill.operators import lookup


@pytest.fixture(autouse=True)
def no_small_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def small(spark, path, hot_rows=40):
    draw = random.Random(4)
    rows = [("hot" if k % 3 == 0 else f"b{draw.randint(0, 60)}", k) for k in range(600)] + [(None, 1000), (None, 1001)]
    return rows, lookup.write_store(spark.createDataFrame(rows, "blob_id string, project long"), path, buckets=4, hot_rows=hot_rows)


@pytest.mark.parametrize("prune", [True, False])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_equals_a_plain_join(spark, tmp_path, how, prune):
    rows, store = small(spark, f"file://{tmp_path}/s")
    wanted = spark.createDataFrame([(b, k) for k, b in enumerate(["hot", "b1", "b1", "none", None, "b7", "hot"])], "blob_id string, w long")
    plain = wanted.join(spark.createDataFrame(rows, "blob_id string, project long"), "blob_id", how)
    got = lookup.look_up(wanted, store, how, prune)
    assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_opened_again(spark, tmp_path):
    rows, store = small(spark, f"file://{tmp_path}/s")
    again = lookup.open_store(spark, store.path)
    assert again.name != store.name and again.rows().count() == len(rows)
    assert lookup.look_up(spark.createDataFrame([("hot",)], "blob_id string"), again).count() == 200


def test_the_store_is_not_moved(spark, tmp_path):
    """No exchange above the store's scan; its filter stands right above it."""
    _, store = small(spark, f"file://{tmp_path}/s")
    wanted = spark.range(200).select(F.concat(F.lit("b"), F.col("id").cast("string")).alias("blob_id"))
    plan = lookup.look_up(wanted, store)._jdf.queryExecution().executedPlan().toString()
    scan = next(k for k, line in enumerate(plan.split("\n")) if "FileScan" in line and "Bucketed: true" in line)
    depth = lambda line: len(re.match(r"[^A-Za-z(*]*", line).group())
    above, at = [], depth(plan.split("\n")[scan])
    for line in reversed(plan.split("\n")[:scan]):
        if depth(line) < at:
            at = depth(line)
            above.append(line)
    names = [re.search(r"[A-Z]\w+", x).group() for x in above]
    join = next(k for k, x in enumerate(names) if x == "SortMergeJoin")
    assert "Exchange" not in names[: join + 1] and "BroadcastHashJoin" in names[:join], names


def test_one_blob_in_a_million_projects(spark, tmp_path):
    """A third of three million rows is one blob's: it is dealt over buckets, and the join finds all of it."""
    n = 3_000_000
    rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.sha1(F.col("id").cast("string").cast("binary"))).alias("blob_id"), F.col("id").alias("project"))
    store = lookup.write_store(rows, f"file://{tmp_path}/s", buckets=16, hot_rows=50_000)
    wanted = spark.range(1, 3001, 3).select(F.sha1(F.col("id").cast("string").cast("binary")).alias("blob_id")).unionByName(spark.createDataFrame([("hot",)], "blob_id string"))
    found = lookup.look_up(wanted, store)
    assert found.agg(F.count("*"), F.countDistinct("project")).first() == (n // 3 + 1000, n // 3 + 1000)
    sizes = [os.path.getsize(tmp_path / "s/rows" / f) for f in os.listdir(tmp_path / "s/rows") if f.endswith(".parquet")]
    assert len(sizes) == 16 and max(sizes) < 2 * sum(sizes) / 16
    share = lookup.pruned_share(wanted.where("blob_id <> 'hot'"), store).first()
    assert share["n_matched"] == 1000 and share["n_passed"] - 1000 < 0.01 * n


def test_filters_merge(spark):
    keys = lambda a, b: spark.range(a, b).select(F.col("id").cast("string").alias("k"))
    blocks = lookup.filter_blocks(2000)
    both = lookup.merge(lookup.bloom(keys(0, 1000), "k", blocks), lookup.bloom(keys(1000, 2000), "k", blocks))
    assert sorted(both.collect()) == sorted(lookup.bloom(keys(0, 2000), "k", blocks).collect())
    assert lookup.might_hold(keys(0, 2000), "k", both, blocks).count() == 2000
    assert lookup.might_hold(keys(10_000, 30_000), "k", both, blocks).count() < 400
    assert lookup.might_hold(keys(0, 100), "k", lookup.bloom(keys(0, 0), "k", 1), 1).count() == 0

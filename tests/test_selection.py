"""Ranks against sorting in plain Python."""

import math
import random

import pytest

from sketchmill.operators import selection, stats

DRAW = random.Random(8)
COLUMNS = {
    "few": ("int", [DRAW.randint(0, 5) for _ in range(300)]),
    "one": ("long", [7]),
    "wide": ("long", [DRAW.randint(-(2**63), 2**63 - 1) for _ in range(300)] + [-(2**63), 2**63 - 1, 0, -1]),
    "crowded": ("long", [2**60 + DRAW.randint(0, 3) for _ in range(200)] + [0, -5]),
    "negative": ("short", [-DRAW.randint(0, 3000) for _ in range(200)]),
    "doubles": ("double", [DRAW.gauss(0, 1) * 10.0 ** DRAW.randint(-300, 300) for _ in range(300)]),
    "odd": ("double", [math.nan, math.inf, -math.inf, 0.0, -0.0, 1.7e308, -1.7e308, 5e-324] * 5 + [None] * 3),
    "float": ("float", [DRAW.random() for _ in range(100)]),
}


@pytest.mark.parametrize("name", COLUMNS)
def test_every_rank(spark, name):
    kind, values = COLUMNS[name]
    rows = spark.createDataFrame([(v,) for v in values], f"v {kind}").repartition(3)
    known = sorted((r["v"] for r in rows.collect() if r["v"] is not None), key=lambda v: (v != v, v))
    ranks = sorted({0, len(known) - 1, *(len(known) * k // 12 for k in range(12))})
    got = selection.select_ranks(rows, "v", ranks)
    assert all(a == b or a != a and b != b for a, b in zip(got, [known[r] for r in ranks]))


def test_ranks_that_are_not_there(spark):
    with pytest.raises(ValueError):
        selection.select_ranks(spark.range(3), "id", [3])
    with pytest.raises(TypeError):
        selection.select_ranks(spark.createDataFrame([("x",)], "v string"), "v", [0])


def test_rank_stats(spark):
    row = stats.rank_stats(spark.range(101), "id", 1).first()
    assert (row["n"], row["min"], row["q1"], row["median"], row["q3"], row["max"], row["mean"]) == (101, 0, 25, 50, 75, 100, 50.0)
    assert set(stats.rank_stats(spark.range(0), "id").first()) == {0}
    plan = stats.rank_stats(spark.range(101), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan

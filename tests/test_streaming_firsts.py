"""The first row of each key on a stream equals the batch, whatever order rows arrive in."""

import random

import pytest

from sketchmill.operators import curate
from sketchmill.streaming import incremental


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_the_batch(spark, tmp_path, seed):
    draw = random.Random(seed)
    rows = [(f"k{draw.randint(0, 6)}", draw.choice(["a", "b", None]), draw.randint(0, 40), draw.choice(["x", None])) for _ in range(120)] + [(None, "a", 1, "x")]
    draw.shuffle(rows)
    schema = "key string, shard string, line long, path string"
    for k in range(6):
        spark.createDataFrame(rows[k::6], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    changes = incremental.first_rows_stream(stream, "key", "shard", "line")
    q = changes.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    made = spark.read.parquet(str(tmp_path / "out"))
    want = curate.first_by_key(spark.createDataFrame(rows, schema).where("key IS NOT NULL"), "key", "shard", "line")
    got = incremental.settled(made)
    assert sorted(map(str, got.select("key", "shard", "line", "path").collect())) == sorted(map(str, want.select("key", "shard", "line", "path").collect()))
    assert made.where("change = -1").count() > 0


def test_keys_share_the_state_of_their_bucket(spark, tmp_path):
    big = (1 << 60) + 1
    rows = [(f"k{i % 90}", None if i % 7 == 0 and i > 300 else big - i, f"p{i}") for i in range(400)]
    schema = "key string, line long, path string"
    for k in range(2):
        spark.createDataFrame(rows[k * 200 : k * 200 + 200], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    changes = incremental.first_rows_stream(stream, "key", "line", buckets=4)
    q = changes.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    made = spark.read.parquet(str(tmp_path / "out"))
    want = {}
    for key, line, path in rows:
        rank = (line is not None, line or 0, path)
        want[key] = min(want.get(key, (rank, None)), (rank, (key, line, path)), key=lambda x: x[0])
    assert sorted(tuple(r) for r in incremental.settled(made).collect()) == sorted(row for _, row in want.values())
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4  # a state and a call a bucket, not a key

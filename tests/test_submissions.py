"""Requests and answers as files: the same final table however the stream is stopped and started."""

import random
from datetime import datetime, timedelta

import pytest

from sketchmill.streaming import submissions

START = datetime(2024, 5, 1)
LIMIT = 600


def case(seed):
    """Rows of both folders by time, and what becomes of each request."""
    draw, rows, want = random.Random(seed), [], {}
    for k in range(60):
        at = draw.randint(0, 3000)
        rows.append((at, submissions.REQUEST, f"r{k}", f"q{k}"))
        if draw.random() < 0.2:
            rows.append((at + 5, submissions.REQUEST, f"r{k}", "again"))
        wait = draw.choice([1, 50, 599, 600, 900, None])
        if wait is not None:
            rows.append((at + wait, submissions.ANSWER, f"r{k}", f"a{k}"))
            if draw.random() < 0.3:
                rows.append((at + wait + 30, submissions.ANSWER, f"r{k}", "second"))
        good = wait is not None and wait < LIMIT
        want[f"r{k}"] = ("answered", START + timedelta(seconds=at + wait), f"a{k}") if good else ("expired", START + timedelta(seconds=at + LIMIT), None)
    rows.append((20_000, submissions.REQUEST, "last", "x"))  # time goes on
    want["last"] = ("submitted", START + timedelta(seconds=20_000), "x")
    return sorted(rows), want


@pytest.mark.parametrize("seed,stops", [(1, 1), (2, 5)])
def test_stopped_and_started_again(spark, tmp_path, seed, stops):
    rows, want = case(seed)
    folders = [str(tmp_path / "requests"), str(tmp_path / "answers")]
    step = -(-len(rows) // stops)
    for begin in range(0, len(rows), step):
        for kind, folder in enumerate(folders):
            own = [(c, START + timedelta(seconds=at), p) for at, k, c, p in rows[begin : begin + step] if k == kind]
            submissions.write_events(spark.createDataFrame(own, submissions.EVENT).coalesce(1), folder)
        steps = submissions.track(submissions.events(spark, *folders), "10 minutes", "1 second")
        q = steps.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        q.awaitTermination()
    made = spark.read.schema(submissions.RESULT).parquet(str(tmp_path / "out"))
    got = {r["custom_id"]: (r["status"], r["at"], r["payload"]) for r in submissions.outcomes(made).collect()}
    assert got == want
    told = [(r["custom_id"], r["status"]) for r in made.collect()]
    assert len(told) == len(set(told)) == 2 * len(want) - 1  # each step once


def test_requests_share_the_state_of_their_bucket(spark, tmp_path):
    rows, want = case(3)
    folders = [str(tmp_path / "requests"), str(tmp_path / "answers")]
    for kind, folder in enumerate(folders):
        submissions.write_events(spark.createDataFrame([(c, START + timedelta(seconds=at), p) for at, k, c, p in rows if k == kind], submissions.EVENT).coalesce(1), folder)
    steps = submissions.track(submissions.events(spark, *folders), "10 minutes", "1 second", buckets=3)
    q = steps.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    q.awaitTermination()
    made = spark.read.schema(submissions.RESULT).parquet(str(tmp_path / "out"))
    assert {r["custom_id"]: (r["status"], r["at"], r["payload"]) for r in submissions.outcomes(made).collect()} == want
    assert made.count() == 2 * len(want) - 1
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3  # a state and a call a bucket, not a request

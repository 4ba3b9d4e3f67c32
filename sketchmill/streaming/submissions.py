"""Requests to an outside classifier across a boundary of files: requests go out as files, answers come in as files.

A stream follows both folders and keeps the state of each request: submitted, then answered or expired, each told once. Requests are held by
buckets of their ids' hash, so that a call, its state row and its timer are shared by some hundreds of them. It can be stopped at any
point and started again with the same checkpoint; the result is the same. What a request becomes depends on the times that its rows carry,
not on when they are read: an answer counts if its time lies before the request's limit; a request expires once the stream's watermark
(the latest time seen, less `delay`) has passed its limit. Answers that come more than `delay` out of order may find their request expired.
Repeated requests and answers change nothing; an answer that is read before its request waits for it; rows of null id are left out, and so is what lies before 1970,
where watermarks begin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "custom_id string, at timestamp, payload string"
RESULT = "custom_id string, status string, at timestamp, payload string"
#: State of a bucket, an entry a request.
HELD = "custom_id array<string>, until array<long>, early_ms array<long>, early array<string>"
BUCKETS = 1 << 14
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

REQUEST, ANSWER = 0, 1


def write_events(rows: DataFrame, path: str) -> None:
    """custom_id, at, payload as JSON lines, added to what is there: requests for the outside, or answers from it."""
    rows.select("custom_id", "at", "payload").write.mode("append").json(path)


def events(spark: SparkSession, requests: str, answers: str, files_at_once: int | None = None) -> DataFrame:
    """The stream of both folders: custom_id, at, payload, kind."""

    def follow(path: str, kind: int) -> DataFrame:
        reader = spark.readStream.schema(EVENT)
        reader = reader.option("maxFilesPerTrigger", files_at_once) if files_at_once else reader
        return reader.json(path).withColumn("kind", F.lit(kind))

    return follow(requests, REQUEST).unionByName(follow(answers, ANSWER)).where("custom_id IS NOT NULL AND at IS NOT NULL")


def _follow(limit_ms: int):
    """What a bucket's requests become by a batch of rows and the watermark."""

    def first(best: dict, name: str, ms: int, payload: str | None) -> None:
        if name not in best or (ms, payload or "") < (best[name][0], best[name][1] or ""):
            best[name] = ms, payload

    def follow(_, frames, state):
        import pandas as pd

        asked, answered, out = {}, {}, []
        for frame in frames:
            for name, kind, ms, payload in zip(*(frame[c].tolist() for c in ("custom_id", "kind", "ms", "payload"))):
                first(asked if kind == REQUEST else answered, name, ms, payload if isinstance(payload, str) else None)
        # of each request: its limit while it is submitted, and an answer that came first; neither once it is told
        held = {name: rest for name, *rest in zip(*state.get)} if state.exists else {}
        for name in {**asked, **answered}:
            until, early_ms, early = held.get(name, (None, None, None))
            if name in held and until is None and early_ms is None:
                continue
            if until is None and name in asked:
                ms, payload = asked[name]
                until = ms + limit_ms
                out.append((name, "submitted", ms, payload))
            if name in answered and (early_ms is None or until is None):
                best = {} if early_ms is None else {name: (early_ms, early)}
                first(best, name, *answered[name])
                early_ms, early = best[name]
            if until is not None and early_ms is not None:
                out.append((name, "answered", early_ms, early) if early_ms < until else (name, "expired", until, None))
                until = early_ms = early = None
            held[name] = [until, early_ms, early]
        passed = state.getCurrentWatermarkMs()
        for name, (until, _, _) in held.items():
            if until is not None and until <= passed:
                out.append((name, "expired", until, None))
                held[name] = [None, None, None]
        state.update(([*held], *map(list, zip(*held.values()))))
        if limits := [until for until, _, _ in held.values() if until is not None]:
            state.setTimeoutTimestamp(max(min(limits) - 1, 1))  # called when the watermark is above this
        if out:
            yield pd.DataFrame(out, columns=["custom_id", "status", "ms", "payload"])

    return follow


def track(rows: DataFrame, limit: str, delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """events -> custom_id, status (submitted, answered, expired), at, payload: a row a step. limit, delay: like '10 minutes'. buckets: state
    rows that the requests are spread over; a batch reads and writes those that it touches whole, so take a thousandth of the requests where
    batches are large, more where they are small. Fixed for the life of a checkpoint."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    spark = rows.sparkSession
    spark.conf.set(PROVIDER, ROCKS)  # off the heap
    limit_ms = spark.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL {limit}) AS ms").first()["ms"]
    bucket = F.pmod(F.xxhash64("custom_id"), F.lit(buckets)).cast("int")
    keyed = rows.select("custom_id", "at", "payload", "kind", F.unix_millis("at").alias("ms"), bucket.alias("bucket")).withWatermark("at", delay).groupBy("bucket")
    steps = keyed.applyInPandasWithState(_follow(limit_ms), "custom_id string, status string, ms long, payload string", HELD, "append", GroupStateTimeout.EventTimeTimeout)
    return steps.select("custom_id", "status", F.timestamp_millis("ms").alias("at"), "payload")


def outcomes(steps: DataFrame) -> DataFrame:
    """custom_id, status, at, payload: the last step of each request."""
    last = F.max_by(F.struct("status", "at", "payload"), F.when(F.col("status") == "submitted", 0).otherwise(1))
    return steps.groupBy("custom_id").agg(last.alias("s")).select("custom_id", "s.*")

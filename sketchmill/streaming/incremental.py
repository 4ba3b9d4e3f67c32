"""The row-local stages on streams: the same Column functions as in batch, plus deduplication within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.preprocess import preprocess
from ..operators.curate import extraction_outcome, has_diagram_extension, length_filter, path_records


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.option("lineSep", "\n").text(path)


def select_paths(lines: DataFrame) -> DataFrame:
    return path_records(lines.where(has_diagram_extension(F.col("value"))))


def clean_diagrams(contents: DataFrame, min_lines: int = 5) -> DataFrame:
    """content -> valid diagrams of enough lines with their cleaned text."""
    valid = contents.withColumn("outcome", extraction_outcome(F.col("content"))).where("outcome.status = 'valid'").drop("outcome")
    return length_filter(valid, "content", min_lines).withColumn("clean", preprocess(F.col("content")))


def dedup_stream(rows: DataFrame, key: str, event_time: str, delay: str = "1 hour") -> DataFrame:
    """Keeps the first row of a key that arrives; state is dropped once the watermark has passed."""
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def first_rows_stream(rows: DataFrame, key: str, *order: str, buckets: int = 1 << 14) -> DataFrame:
    """The first row of each key in the given order, whatever order rows arrive in: the columns of rows, and change int.

    A key's least row so far is held in state. A row that comes before it is emitted with change 1, and the one that it replaces with
    change -1; summing changes up (`settled`) gives at any time what a batch over all rows so far gives. Rows of null key have none. State
    is kept for as long as the query runs, as a late row may always come. Keys are spread over so many buckets by hash; keys of a bucket share
    a call and a state row, which a batch that touches it reads and writes whole: take a thousandth of the keys where batches are large, more
    where they are small. Fixed for the life of a checkpoint.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    columns, kinds = rows.columns, rows.schema
    whole = {k for k, f in enumerate(kinds) if isinstance(f.dataType, IntegralType)}  # sent as text: pandas would turn those beside nulls into floats
    at, ranks = columns.index(key), [columns.index(c) for c in (*order, *[c for c in columns if c != key and c not in order])]

    def rank(row: tuple) -> tuple:
        """Nulls come first, as in a batch."""
        return tuple((row[k] is not None, row[k]) if row[k] is not None else (False,) for k in ranks)

    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, bytearray):
            return bytes(v)
        return v.to_pydatetime() if hasattr(v, "to_pydatetime") else v.item() if hasattr(v, "item") else v

    def keep(_, frames, state):
        held = [tuple(map(plain, row)) for row in state.get[0]] if state.exists else []
        least = {row[at]: row for row in held}
        before = {}  # of the keys whose row has changed: the row that was held
        for frame in frames:
            for row in frame[columns].astype(object).itertuples(index=False, name=None):
                row = tuple(int(v) if k in whole and v is not None else v for k, v in enumerate(map(plain, row)))
                now = least.get(row[at])
                if now is None or rank(row) < rank(now):
                    before.setdefault(row[at], now)
                    least[row[at]] = row
        if before:
            state.update(([*least.values()],))
            out = [(*row, -1) for row in before.values() if row is not None] + [(*least[k], 1) for k in before]
            yield pd.DataFrame(out, columns=[*columns, "change"], dtype=object)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds)
    held = "rows array<struct<" + ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in kinds) + ">>"
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("_bucket")
    sent = [F.col(f.name).cast("string").alias(f.name) if k in whole else F.col(f.name) for k, f in enumerate(kinds)]
    grouped = rows.where(F.col(key).isNotNull()).select(*sent, bucket).groupBy("_bucket")
    return grouped.applyInPandasWithState(keep, f"{ddl}, change int", held, "append", GroupStateTimeout.NoTimeout)


def settled(changes: DataFrame) -> DataFrame:
    """Rows whose changes sum to one: what stands after all changes so far."""
    kept = [c for c in changes.columns if c != "change"]
    return changes.groupBy(*kept).agg(F.sum("change").alias("_n")).where("_n = 1").select(*kept)


def counts_by_window(rows: DataFrame, event_time: str, width: str, *keys: str, delay: str = "1 hour") -> DataFrame:
    w = F.window(event_time, width)
    return rows.withWatermark(event_time, delay).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")

"""What the operators share: scratch tables in the shared folder, and byte-level text kernels on Arrow buffers."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text is handled in slices of about so many bytes, whatever the size of an Arrow batch; a longer document is a slice of its own.
SLICE_BYTES = 2_000_000

_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


# ---------------------------------------------------------------- scratch tables


@functools.lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="sketchmill-")


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). A temporary one only where that is unset and everything runs in one
    process, as in tests; on a cluster an unset folder is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    return _own_folder()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/sketchmill/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str, compression: str = "zstd") -> str:
    """Writes df into the shared folder and returns its path: cuts lineage, and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name))


def drop_table(spark: SparkSession, path: str) -> None:
    """Removes a scratch table that no later plan reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def working_tables(spark: SparkSession):
    """Gives keep(df, name), which writes a table into the shared folder and reads it again; all of them are removed at the end."""
    paths: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        paths.append(write_table(df, name))
        release(spark)
        return spark.read.schema(df.schema).parquet(paths[-1])

    try:
        yield keep
    finally:
        for path in paths:
            drop_table(spark, path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner see which shuffle files no plan holds any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo a number; null ids count as 0 (as the empty text has crc32 0)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0)) % modulus


def extended(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of df with further columns."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


def shield(df: DataFrame, *used: str):
    """df with every column that is not used under a name of no meaning, so that extra columns can't clash with an operator's own;
    and a function that restores the columns of df (and their order) on what an operator returns."""
    names = {c: c if c in used else f"__kept_{k}" for k, c in enumerate(df.columns)}
    hidden = df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return hidden, lambda out: out.select(*[F.col(n).alias(c) for c, n in names.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- bytes of Arrow columns


def string_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column as (uint8 data, int64 offsets); null becomes empty."""
    import pyarrow as pa

    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, off, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, last - first, first) if last > first else np.zeros(0, np.uint8)
    return raw, offsets - first


def slices(data: np.ndarray, offsets: np.ndarray, most: int = SLICE_BYTES):
    """Yields (first row, past the last row, data, offsets from 0) of runs of whole rows of about `most` bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` on lower-cased UTF-8 bytes (A-Z have become a-z).
ALNUM_WORD = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: `[^\x20\x09-\x0D]`
SPACED_WORD = ~byte_set((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as (start, end) in data, and for each row the number of words before it (one more entry than rows)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    mask = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = mask.copy()
    begins[1:] &= ~mask[:-1] | edge[1:n]
    ends = mask.copy()
    ends[:-1] &= ~mask[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets, "left")


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _BASE_INV):
        p = np.empty(n, np.uint64)
        p[0] = 1
        k = 1
        while k < n:  # doubling
            step = np.uint64(pow(base, k, 1 << 64))
            m = min(k, n - k)
            p[k : k + m] = p[:m] * step
            k += m
        out.append(p)
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, step: int = 1 << 20, letters: np.ndarray = LOWER) -> np.ndarray:
    """64-bit hashes of the words, lower-cased unless `letters` says otherwise; worked off in runs of at most about `step` bytes (longer only for one longer word)."""
    out = np.empty(len(start), np.uint64)
    i, n = 0, len(start)
    while i < n:
        j = max(i + 1, int(np.searchsorted(end, start[i] + step, "right")))
        a, b = int(start[i]), int(end[j - 1])
        size = b - a
        p, q = _powers(max(1 << 12, 1 << (size + 1).bit_length()))
        total = np.zeros(size + 1, np.uint64)
        np.cumsum((letters[data[a:b]].astype(np.uint64) + np.uint64(1)) * p[:size], out=total[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = (total[e] - total[s]) * q[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        i = j
    return mix(out)

"""Joining a few wanted blobs with a map of an archive's size.

The map is written once, as a store of Parquet files bucketed by blob and salt: a blob that very many rows share (a hot one) is dealt over
salts, so that no bucket holds it whole, and the hot blobs are listed beside the store. A join moves the wanted side alone: its rows go to
the store's buckets, those of a hot blob once for each of its salts. What is wanted is also summed up in a Bloom filter (blocks of 256
bits, merged by a bitwise or), which rows of the store meet right above the scan, before anything else is done with them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A blob with more rows than this is hot; it is dealt over a salt for each so many rows.
HOT_ROWS = 1_000_000
#: A bucket has about so many rows, unless a number of buckets is given.
BUCKET_ROWS = 2_000_000
#: Lists of hot blobs and filters are broadcast up to these sizes; a larger list is joined by a shuffle, a larger filter is left out.
BROADCAST_HOT, FILTER_BYTES = 100_000, 64 << 20
#: Bits of the filter for each wanted blob, and words of 32 bits in a block.
BITS, WORDS = 16, 8
#: Odd multipliers under 2**31, one a word, that pick its bit (fixed values: filters that are to be merged must agree on them).
MULTIPLIERS = (0x47B6137B, 0x44974D91, 0x705495C7, 0x2DF1424B, 0x5C6BFB31, 0x1B873593, 0x2545F491, 0x7FEB352D)


# ---------------------------------------------------------------- Bloom filters


def _place(key: Column, blocks: int) -> Column:
    return F.pmod(F.shiftright(F.xxhash64(key), 32), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    """The bit of each word that a key sets, as a long."""
    low = F.xxhash64(key).bitwiseAND(F.lit(0xFFFFFFFF))
    at = [F.shiftright((low * F.lit(m)).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int") for m in MULTIPLIERS]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), n) for n in at]


def filter_blocks(expected: int) -> int:
    """How many blocks a filter for so many keys has."""
    return max(1, -(-expected * BITS // (32 * WORDS)))


def bloom(keys: DataFrame, column: str, blocks: int) -> DataFrame:
    """block int, w0.. long: a row a block that holds any key. Summed map-side; keys that come repeatedly change nothing."""
    key = F.col(column)
    made = keys.where(key.isNotNull()).select(_place(key, blocks).alias("block"), *[b.alias(f"w{k}") for k, b in enumerate(_bits(key))])
    return made.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)])


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """The filter of the keys of either; both with the same number of blocks."""
    return a.unionByName(b).groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)])


def might_hold(rows: DataFrame, column: str, held: DataFrame, blocks: int) -> DataFrame:
    """The rows whose key the filter may hold: all that it does hold, and about a hundredth of the others. No row is moved."""
    key, names = F.col(column), [f"_w{k}" for k in range(WORDS)]
    block = F.broadcast(held.select(F.col("block").alias("_block"), *[F.col(f"w{k}").alias(n) for k, n in enumerate(names)]))
    met = rows.join(block, _place(key, blocks) == F.col("_block"))
    hit = [F.col(n).bitwiseAND(b) != 0 for n, b in zip(names, _bits(key))]
    for test in hit:
        met = met.where(test)
    return met.drop("_block", *names)


# ---------------------------------------------------------------- the store


@dataclass(frozen=True)
class BlobStore:
    """A map written by `write_store`. name: of its table in this session's catalog; path: of its files."""

    spark: SparkSession
    name: str
    path: str
    key: str

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def hot(self) -> DataFrame:
        """The hot blobs: key, salts int."""
        return self.spark.read.parquet(f"{self.path}/hot")


def _register(spark: SparkSession, schema, path: str, key: str, buckets: int) -> str:
    name = f"blob_store_{uuid.uuid4().hex}"
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE {name} ({ddl}) USING parquet CLUSTERED BY (`{key}`, `salt`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}/rows'")
    return name


def write_store(rows: DataFrame, path: str, key: str = "blob_id", buckets: int | None = None, hot_rows: int = HOT_ROWS) -> BlobStore:
    """Writes rows as a store; path must be new. Rows without a key are kept and match nothing. Salts are drawn by a hash of the whole row."""
    spark = rows.sparkSession
    buckets = buckets or rows.count() // BUCKET_ROWS + 1
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > hot_rows)
    counts.select(key, F.ceil(F.col("n") / hot_rows).cast("int").alias("salts")).write.parquet(f"{path}/hot")
    hot = spark.read.schema(f"`{key}` {rows.schema[key].dataType.simpleString()}, salts int").parquet(f"{path}/hot")
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_HOT else hot
    salted = rows.join(hot, key, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("salts")), F.lit(0)).cast("int")).select(*rows.columns, "salt")
    name = f"blob_store_{uuid.uuid4().hex}"
    dealt = salted.repartition(buckets, key, "salt")
    dealt.write.bucketBy(buckets, key, "salt").sortBy(key).option("path", f"{path}/rows").format("parquet").saveAsTable(name)
    spark.createDataFrame([(key, buckets)], "key string, buckets int").coalesce(1).write.parquet(f"{path}/about")
    return BlobStore(spark, name, path, key)


def open_store(spark: SparkSession, path: str) -> BlobStore:
    """A store that another session wrote."""
    about = spark.read.parquet(f"{path}/about").first()
    schema = spark.read.parquet(f"{path}/rows").schema
    return BlobStore(spark, _register(spark, schema, path, about["key"], about["buckets"]), path, about["key"])


def look_up(wanted: DataFrame, store: BlobStore, how: str = "inner", prune: bool = True) -> DataFrame:
    """wanted joined with the store by its key (inner, left or left_semi). The store's rows stay where they are."""
    key = store.key
    if how != "inner":
        found = look_up(wanted.select(key).distinct(), store, "inner", prune).select(key).distinct()
        if how == "left_semi":
            return wanted.join(found, key, "left_semi")
        # a wanted row without a match comes once, whatever its salts: it is added to what matched
        return look_up(wanted, store, "inner", prune).unionByName(wanted.join(found, key, "left_anti"), allowMissingColumns=True)
    hot = store.hot()
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_HOT else hot
    copies = F.when(F.col("salts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("salts") - 1))
    spread = wanted.join(hot, key, "left").withColumn("salt", F.explode(copies)).drop("salts")
    rows = store.rows()
    if prune:
        keys = wanted.select(key).distinct()
        blocks = filter_blocks(keys.count())
        if blocks * WORDS * 8 <= FILTER_BYTES:
            rows = might_hold(rows, key, bloom(keys, key, blocks), blocks)
    return spread.join(rows, [key, "salt"]).drop("salt")


def pruned_share(wanted: DataFrame, store: BlobStore) -> DataFrame:
    """One row: rows of the store, rows that pass the filter, rows that match."""
    key = store.key
    keys = wanted.select(key).distinct()
    blocks = filter_blocks(keys.count())
    passed = might_hold(store.rows(), key, bloom(keys, key, blocks), blocks)
    counts = [x.agg(F.count("*").alias(n)) for x, n in ((store.rows(), "n_rows"), (passed, "n_passed"), (look_up(keys, store), "n_matched"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # one row each

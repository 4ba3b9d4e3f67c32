"""Line shards as a data source: lines with their exact numbers, without a sort or a shuffle.

A compressed shard is one partition; a plain one is cut into blocks, and a line belongs to the block that it starts in. A task streams its
block and numbers what it reads from 1. Where a shard has several blocks, or numbers over all shards are asked for, a first pass counts
lines (`count_lines`): one row a block, whose running sums are broadcast and added. What can't be read is a row with a reason.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK_BYTES = 128 << 20
#: A task reads so many bytes at a time; a longer line is held whole.
PIECE_BYTES = 4 << 20
#: An index is broadcast up to so many blocks, else joined by a shuffle of rows that carry text.
BROADCAST_BLOCKS = 2_000_000
COMPRESSED = {".gz": "gzip", ".s": "gzip", ".bz2": "bz2", ".zst": "zstd"}
_SCHEMES = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}


def open_store(path: str):
    """A file system and the path in it. Paths name their store, as Spark's own listings do; without one they are local."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return fs.LocalFileSystem(), "/" + (rest if colon else path).lstrip("/")
    authority, _, inside = rest.removeprefix("//").partition("/")
    scheme = _SCHEMES.get(scheme, scheme)
    store, root = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return store, f"{root.rstrip('/')}/{inside}"


def compression(path: str) -> str | None:
    return next((kind for end, kind in COMPRESSED.items() if path.endswith(end)), None)


@dataclass
class Block(InputPartition):
    shard: str
    start: int
    end: int | None  # None: to the shard's end


def pieces_of(block: Block):
    """The bytes of a block's lines: from the first line that starts in it to the end of the last one, in pieces."""
    store, path = open_store(block.shard)
    kind = compression(block.shard)
    if kind:
        # the file's own bytes: a damaged end must not hide the lines before it
        with store.open_input_stream(path, compression=kind) as stream:
            while data := stream.read(PIECE_BYTES):
                yield data
        return
    with store.open_input_file(path) as file:
        at = max(block.start - 1, 0)
        file.seek(at)
        skipping, last = block.start > 0, block.end if block.end is not None else None
        while data := file.read(PIECE_BYTES):
            begin = at
            at += len(data)
            if skipping:
                cut = data.find(b"\n")
                if cut < 0:
                    if last is not None and at >= last:
                        return  # one line covers the block
                    continue
                data, begin, skipping = data[cut + 1 :], begin + cut + 1, False
                if last is not None and begin >= last:
                    return
            if last is not None and at >= last:  # the line that is open at the block's last byte ends it
                cut = data.find(b"\n", max(last - 1 - begin, 0))
                if cut >= 0:
                    yield data[: cut + 1]
                    return
            yield data


class LineShards(DataSource):
    """Format `line_shards`: shard, block, nth (from 1 in the block), value, reason. Options: shards (JSON: path and bytes of each), blockSize."""

    @classmethod
    def name(cls) -> str:
        return "line_shards"

    def schema(self) -> str:
        return "shard string, block long, nth long, value string, reason string"

    def reader(self, schema) -> DataSourceReader:
        return LineReader(self.options)


class LineReader(DataSourceReader):
    def __init__(self, options):
        self.shards, self.size = json.loads(options["shards"]), int(options.get("blockSize", BLOCK_BYTES))

    def partitions(self) -> list[Block]:
        out = []
        for path, length in self.shards:
            if compression(path) or length <= self.size:
                out.append(Block(path, 0, None))
            else:
                cuts = [*range(0, length, self.size), length]
                out += [Block(path, a, b) for a, b in zip(cuts[:-1], cuts[1:])]
        return out or [Block("", 0, 0)]

    def read(self, block: Block):
        import pyarrow as pa

        if not block.shard:
            return
        nth = 0

        def batch(lines: list[bytes], reason: str | None = None):
            nonlocal nth
            n = len(lines)
            numbers = pa.array(range(nth + 1, nth + n + 1), pa.int64())
            nth += n
            reasons = [reason] * n
            try:
                values = pa.array(lines, pa.binary()).cast(pa.string())
            except pa.ArrowInvalid:
                read = []
                for k, line in enumerate(lines):
                    try:
                        read.append(line.decode())
                    except UnicodeDecodeError as e:
                        read.append(line.decode(errors="replace"))
                        reasons[k] = f"bad UTF-8 at byte {e.start}"
                values = pa.array(read, pa.string())
            if reason:
                values = pa.nulls(n, pa.string())
            cols = [pa.array([block.shard] * n, pa.string()), pa.array([block.start] * n, pa.int64()), numbers, values, pa.array(reasons, pa.string())]
            return pa.RecordBatch.from_arrays(cols, ["shard", "block", "nth", "value", "reason"])

        held: list[bytes] = []  # the pieces of a line that is not yet whole
        broken = None
        try:
            for data in pieces_of(block):
                *whole, rest = data.split(b"\n")
                if whole:
                    whole[0] = b"".join([*held, whole[0]])
                    held = []
                    yield batch(whole)
                if rest:
                    held.append(rest)
        except OSError as e:
            if not compression(block.shard):
                raise
            broken = f"unreadable from here: {e}"
        if held:
            yield batch([b"".join(held)])
        if broken:
            yield batch([b""], broken)


class LineCounts(LineShards):
    """Format `line_counts`: shard, block, n: the lines of each block, as line_shards gives them."""

    @classmethod
    def name(cls) -> str:
        return "line_counts"

    def schema(self) -> str:
        return "shard string, block long, n long"

    def reader(self, schema) -> DataSourceReader:
        return CountReader(self.options)


class CountReader(LineReader):
    def read(self, block: Block):
        if not block.shard:
            return
        n, open_line = 0, False
        try:
            for data in pieces_of(block):
                n += data.count(b"\n")
                open_line = not data.endswith(b"\n")
        except OSError:
            if not compression(block.shard):
                raise
            n += 1  # the row that says so
        yield block.shard, block.start, n + open_line


def list_shards(spark: SparkSession, *paths: str) -> list[tuple[str, int]]:
    """Path and length of every file, by path. A path that names nothing is an error, before any work."""
    from .readers import path_exists

    missing = [p for p in paths if not path_exists(spark, p)]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "length")
    return sorted((r["path"], r["length"]) for r in rows.collect())  # a row a file


def _load(spark: SparkSession, source: type[DataSource], shards, block_bytes: int) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).option("shards", json.dumps(shards)).option("blockSize", block_bytes).load()


def count_lines(spark: SparkSession, *paths: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """shard, block, n, in_shard and overall: the lines of each block, of the shard's blocks before it, and of all blocks before it."""
    counts = _load(spark, LineCounts, list_shards(spark, *paths), block_bytes)
    upto = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select("*", upto(Window.partitionBy("shard").orderBy("block")).alias("in_shard"), upto(Window.orderBy("shard", "block")).alias("overall"))  # a row a block


def numbered_lines(spark: SparkSession, *paths: str, overall: bool = False, block_bytes: int = BLOCK_BYTES, index: DataFrame | None = None) -> DataFrame:
    """shard, line_no long (from 1 in the shard), value, reason (null but for lines that can't be read as they stand); with `overall`, row_no
    long too: from 1 over all shards by path. index: what count_lines gave for the same paths and block size, if it is at hand."""
    shards = list_shards(spark, *paths)
    lines = _load(spark, LineShards, shards, block_bytes)
    if not overall and all(compression(p) or n <= block_bytes for p, n in shards):
        return lines.select("shard", F.col("nth").alias("line_no"), "value", "reason")
    if index is None:
        from .scratch import shared_path

        path = shared_path(spark, "line-index")
        count_lines(spark, *paths, block_bytes=block_bytes).write.parquet(path)
        index = spark.read.parquet(path)
    blocks = sum(1 if compression(p) else max(1, -(-n // block_bytes)) for p, n in shards)
    small = index.select("shard", "block", "in_shard", "overall")
    met = lines.join(F.broadcast(small) if blocks <= BROADCAST_BLOCKS else small, ["shard", "block"])
    numbers = [(F.col("in_shard") + F.col("nth")).alias("line_no"), *[(F.col("overall") + F.col("nth")).alias("row_no")] * overall]
    return met.select("shard", *numbers, "value", "reason")

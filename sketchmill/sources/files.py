"""A writer of text files whose rows become visible together: all routes in one pass, and nothing of an attempt that fails.

Format `text_files`. Rows: directory (null: right below the path), file_name, value. A row with a name is a file; rows without one are lines of
their directory's part files, a part a task. A task attempt writes below `_staging` in the target folder, which Spark's readers don't see;
the commit moves what the attempts that Spark counts wrote to its place (a whole directory at once where it is new), removes the rest and
writes `_SUCCESS`; an abort removes all of it. Stores are those that pyarrow opens.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .shards import open_store

ENDS = {"gzip": ".txt.gz", "bz2": ".txt.bz2", "zstd": ".txt.zst"}
#: Lines of a part are handed to the store in runs: of so many, or up to one of so many bytes.
RUN_LINES, RUN_BYTES = 256, 1 << 20


@dataclass
class Written(WriterCommitMessage):
    attempt: str


def checked_name(part: str) -> str:
    if "/" in part or part in ("", ".", "..") or part.startswith("_staging"):
        raise ValueError(f"not a name of a file or folder: {part!r}")
    return part


class TextFiles(DataSource):
    """Options: path; compression (JSON: codec by directory, for part files)."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "directory string, file_name string, value string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("text_files only appends")
        return TextFilesWriter(self.options)


class TextFilesWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.codecs = options["path"].rstrip("/"), json.loads(options.get("compression", "{}"))
        self.job = f"_staging/{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        store, root = open_store(self.path)
        attempt = f"{self.job}/{uuid.uuid4().hex}"
        made: set[str] = set()
        parts: dict[str | None, tuple] = {}

        def folder(directory: str | None) -> str:
            at = f"{root}/{attempt}" if directory is None else f"{root}/{attempt}/{checked_name(directory)}"
            if at not in made:
                store.create_dir(at, recursive=True)
                made.add(at)
            return at

        def part(directory: str | None):
            if directory not in parts:
                codec = self.codecs.get(directory or "")
                name = f"part-{uuid.uuid4().hex}{ENDS.get(codec, '.txt')}"
                parts[directory] = store.open_output_stream(f"{folder(directory)}/{name}", compression=codec), []
            return parts[directory]

        try:
            for batch in iterator:
                for directory, name, value in zip(*[batch.column(c).to_pylist() for c in ("directory", "file_name", "value")]):
                    data = (value or "").encode()
                    if name is not None:
                        with store.open_output_stream(f"{folder(directory)}/{checked_name(name)}", compression=None) as out:
                            out.write(data)
                        continue
                    stream, held = part(directory)
                    held.append(data)
                    if len(data) >= RUN_BYTES or len(held) >= RUN_LINES:
                        stream.write(b"\n".join(held) + b"\n")
                        held.clear()
        finally:
            for stream, held in parts.values():
                if held:
                    stream.write(b"\n".join(held) + b"\n")
                stream.close()
        return Written(attempt)

    def commit(self, messages) -> None:
        from pyarrow import fs

        store, root = open_store(self.path)
        store.create_dir(root, recursive=True)
        there = lambda at: store.get_file_info(at).type != fs.FileType.NotFound
        single: list[tuple[str, str]] = []
        for message in messages:
            if message is None or not there(f"{root}/{message.attempt}"):
                continue
            for info in store.get_file_info(fs.FileSelector(f"{root}/{message.attempt}")):
                target = f"{root}/{info.base_name}"
                if info.type == fs.FileType.File:
                    single.append((info.path, target))
                elif not there(target):
                    store.move(info.path, target)
                else:
                    single += [(x.path, f"{target}/{x.base_name}") for x in store.get_file_info(fs.FileSelector(info.path))]

        def place(pair) -> None:
            if there(pair[1]):
                store.delete_file(pair[1])
            store.move(*pair)

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(place, single))
        self._clear(store, root)
        with store.open_output_stream(f"{root}/_SUCCESS", compression=None):
            pass

    def abort(self, messages) -> None:
        self._clear(*open_store(self.path))

    def _clear(self, store, root: str) -> None:
        from pyarrow import fs

        for at in (f"{root}/{self.job}", f"{root}/_staging"):
            if store.get_file_info(at).type == fs.FileType.Directory and (at.endswith(self.job) or not store.get_file_info(fs.FileSelector(at))):
                store.delete_dir(at)


def qualified(spark: SparkSession, path: str) -> str:
    """path with its store: one without a scheme is in Spark's default file system, wherever it is resolved."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def write_files(rows: DataFrame, path: str, directory: Column, file_name: Column, value: Column, compression: dict[str, str] | None = None, fresh: bool = True) -> int:
    """Writes rows as text_files below path; gives their number. fresh: it is an error if something is there. Otherwise files of the same
    names are replaced at the commit."""
    from .readers import path_exists

    spark = rows.sparkSession
    path = qualified(spark, path)
    if fresh and path_exists(spark, f"{path}/[!_]*"):
        raise FileExistsError(path)
    spark.dataSource.register(TextFiles)
    counted = Observation()
    kept = rows.select(directory.cast("string").alias("directory"), file_name.cast("string").alias("file_name"), value.cast("string").alias("value"))
    kept.observe(counted, F.count(F.lit(1)).alias("n")).write.format("text_files").mode("append").option("compression", json.dumps(compression or {})).save(path)
    return counted.get["n"]

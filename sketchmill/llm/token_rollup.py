"""Token counts as additive rollups, maintained by deltas.

Every change is a signed row: an insert counts +1, a delete -1, and a revised count is the old row with -1 and the new row with
+1. A batch of changes is summed by source, language and tokenizer version (map-side first, so a hot source sends one row a task)
and committed as one small table `batch=<id>`: written beside the batches and renamed into place when it is whole, which fails where
the id is there. So committing an id again does nothing, of two writers of one id one counts, and an unfinished commit (lost driver
or executors) leaves a folder that nothing reads. Totals are the sum over committed batches; `compact` folds batches into one.

Defined results: null text has 0 tokens; a null source or lang is a group of its own; repeated rows count as often as they occur;
groups that fall to 0 documents and 0 tokens are left out of the totals; an empty table commits an empty batch; extra columns are
ignored. Whole texts are counted.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED_WORD, drop_table, extended, scratch_path, slices, spans, string_buffers, table, working_tables
from .packing import default_tokenizer_path, encode

KEYS = ("source", "lang", "tokenizer")
#: Versions: a vocabulary file's path, or None for words `[^\x20\x09-\x0D]+`.
WORDS = "words-1"
BPE = "byte-bpe-50k-1"
#: Ids whose texts are to be counted in a second form are broadcast up to so many (16 MB of longs); beyond, all texts are counted in both.
BROADCAST_IDS = 1_000_000


def production_versions() -> dict[str, str | None]:
    return {BPE: default_tokenizer_path(), WORDS: None}


def count_tokens(documents: DataFrame, versions: dict[str, str | None], texts: tuple[str, ...] = ("text",), keep: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """The kept columns, tokenizer, and n_tokens long (of the first text column; n_tokens_<name> of further ones); a row for each document
    and version."""
    kept = documents.select(*keep, *texts)
    bare = kept.select(*keep)
    names = ["n_tokens", *[f"n_tokens_{t}" for t in texts[1:]]]

    def count(batches):
        import numpy as np
        import pyarrow as pa

        def lengths(column, path):
            if path is not None:
                return np.array([len(encode(path, x.as_py() or "")) for x in column], np.int64)
            data, offsets = string_buffers(column)
            return np.concatenate([np.diff(spans(part, off, SPACED_WORD)[2]) for _, _, part, off in slices(data, offsets)] or [np.zeros(0, np.int64)])

        for batch in batches:
            for name, path in versions.items():
                found = [pa.array(lengths(batch.column(len(keep) + k), path), pa.int64()) for k in range(len(texts))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([name] * batch.num_rows, pa.string()), *found], [*keep, "tokenizer", *names])

    return kept.mapInArrow(count, extended(bare, "tokenizer string, " + ", ".join(f"{n} long" for n in names)))


def inserted(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(1))


def deleted(counts: DataFrame) -> DataFrame:
    return counts.withColumn("sign", F.lit(-1))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    return deleted(before).unionByName(inserted(after))


class Rollup:
    """The committed batches in a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _batch(self, batch_id: str) -> str:
        if not batch_id or not all(c.isalnum() or c in "-_" for c in batch_id):
            raise ValueError("a batch id has letters, digits, - and _ only")
        return f"{self.path}/batch={batch_id}"

    def is_committed(self, batch_id: str) -> bool:
        fs, p = self._fs(f"{self._batch(batch_id)}/_SUCCESS")
        return fs.exists(p)

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """changes: source, lang, tokenizer, n_tokens, sign. False where this batch was committed before."""
        target = self._batch(batch_id)
        if self.is_committed(batch_id):
            return False
        summed = changes.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("long").alias("n_tokens"))
        written = f"{self.path}/_unfinished-{batch_id}-{uuid.uuid4().hex}"
        summed.write.parquet(written)
        return self._move(written, target)

    def _move(self, written: str, target: str) -> bool:
        """Renames a whole table to the name that counts; False, and the table removed, where that name is taken. A folder without its marker
        is no batch (a whole one has it before it is renamed) and goes."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        fs, source = self._fs(written)
        source = fs.makeQualified(source)
        if fs.exists(self._fs(target)[1]) and not self.is_committed(target.rpartition("=")[2]):
            drop_table(self.spark, target)
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), conf).rename(source, fs.makeQualified(jvm.org.apache.hadoop.fs.Path(target)), options)
        except Py4JJavaError:
            if not self.is_committed(target.rpartition("=")[2]):
                raise
            drop_table(self.spark, written)
            return False
        return True

    def batches(self) -> list[str]:
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(n[6:] for n in names if n.startswith("batch=") and self.is_committed(n[6:]))

    def totals(self) -> DataFrame:
        paths = [self._batch(b) for b in self.batches()]
        if not paths:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs long, n_tokens long")
        got = self.spark.read.parquet(*paths).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return got.where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self, into: str) -> Rollup:
        """The same totals as one batch `base` in another folder; ids folded in are listed there, so they stay committed."""
        new = Rollup(self.spark, into)
        old = self.batches()
        self.totals().write.mode("overwrite").parquet(new._batch("base"))
        empty = self.totals().limit(0)
        for b in old:
            if b != "base":
                empty.write.mode("overwrite").parquet(new._batch(b))
        return new


def op1_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads all documents; revises those labelled low quality to their text with white space runs as one space; deletes those labelled toxic
    (as revised, if they were); then tries the first batch again, which changes nothing."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    squeezed = F.regexp_replace("text", r"\s+", " ")
    revised_ids = labels.where("quality = 0 AND doc_id IS NOT NULL").select("doc_id", F.lit(True).alias("revised"))
    if revised_ids.count() <= BROADCAST_IDS:  # the other texts' second form is null, and isn't counted
        documents, squeezed = documents.join(F.broadcast(revised_ids), "doc_id", "left"), F.when(F.col("revised"), squeezed)
    low, now = F.coalesce(F.col("quality") == 0, F.lit(False)), F.col("n_tokens_squeezed").alias("n_tokens")
    rollup = Rollup(spark, scratch_path(spark, "token-rollup"))
    with working_tables(spark) as keep:
        # Both forms of a text are counted where it is read: no text is ever shuffled.
        counts = keep(count_tokens(documents.withColumn("squeezed", squeezed), production_versions(), ("text", "squeezed"), ("doc_id", "source", "lang")), "token-counts")
        marked = keep(counts.join(labels.where("quality = 0 OR toxic = 1"), "doc_id"), "marked-counts")
        before = counts.select(*KEYS, "n_tokens")
        recounted = marked.where(low)
        gone = marked.where("toxic = 1").select(*KEYS, F.when(low, F.col("n_tokens_squeezed")).otherwise(F.col("n_tokens")).alias("n_tokens"))
        rollup.commit("load", inserted(before))
        rollup.commit("squeeze-low-quality", revised(recounted.select(*KEYS, "n_tokens"), recounted.select(*KEYS, now)))
        rollup.commit("delete-toxic", deleted(gone))
        rollup.commit("load", inserted(before))
    return rollup.totals()

"""The corpus pipeline: quality, language, near-duplicates, contamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; `run` writes each stage's rows as Parquet into the
folder that the cluster shares and reads them again for the next one. All but the last stage return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sketchmill.llm import decontaminate, language_id, near_dedup, packing, quality_crf
from sketchmill.llm.common import drop_table, shield, table, write_table

#: Documents whose language is this uncertain go.
LANGUAGE_FLOOR = 0.5
#: Documents that their nearest language codes no shorter than plain bytes go: they are in none of the learned languages.
PLAIN_BITS = 8.0


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field predicts to be of quality 1 stay, every row by its own text. Null and empty texts go by the share of
    label 1 in training; without any labels that share is a half, and all rows stay."""
    hidden, restore = shield(docs, "doc_id", "text")
    model = quality_crf.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return restore(quality_crf.score_quality(hidden, model).where("predicted = 1"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages stay: those without a letter, with a posterior under LANGUAGE_FLOOR, or of PLAIN_BITS a byte
    and more under their nearest language go (so does a text in a script that no learned language uses). Without any language all go."""
    hidden, restore = shield(docs, "doc_id", "text")
    found = language_id.identify(hidden, language_id.train(docs.select("doc_id", "text", "lang")), "bits_a_byte")
    sure = (F.col("score") >= LANGUAGE_FLOOR) & (F.col("bits_a_byte") < PLAIN_BITS)
    return restore(found.where((F.col("lang_pred") != language_id.UNKNOWN) & sure))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays. Rows are told apart by doc_id and text: a doc_id that occurs with texts of several components
    stays once for each of them. Null and empty texts are linked with nothing but their own repeated rows, and stay; an empty table gives
    no rows."""
    hidden, restore = shield(docs, "doc_id", "text")
    kept = near_dedup.one_a_component(docs.select("doc_id", "text")).toDF("id", "hash", "count")
    kept = spark.read.parquet(write_table(kept, "kept"))
    hidden = hidden.withColumn("text_hash", F.xxhash64("text"))
    out = hidden.join(kept.select("id", "hash"), hidden["doc_id"].eqNullSafe(kept["id"]) & (hidden["text_hash"] == kept["hash"]), "left_semi")
    repeated = not kept.where("`count` > 1").isEmpty()
    return restore(out.dropDuplicates(["doc_id", "text_hash"]) if repeated else out)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words at least a twentieth lie in passages of the benchmark go, every row by its own text; null and empty texts
    have no words and stay, and so does everything where the benchmark is empty."""
    hidden, restore = shield(docs, "doc_id", "text")
    return restore(decontaminate.remove_contaminated(hidden, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row becomes pieces with a place in a sequence: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty
    texts are one piece with the end token alone; null and repeated ids are rows like any other; no rows give no rows."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: SQL can't express the field, the context trees or the tokenizer; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = write_table(out, f"stage-{name}", "snappy")
        docs = spark.read.parquet(path)
        if before:
            drop_table(spark, before)
        before = path
    return docs

"""Diagram corpora rendered from relational tables, so that what the text operators find can be compared with what the tables say.

Only integers and strings go into the text. The corpora are inputs of the registered queries; they are not operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSION_CYCLE = (".puml", ".pu", ".plantuml", ".wsd", ".iuml", ".uml", ".txt", ".PUML")
TYPE_CYCLE = ("sequence", "class", "usecase", "component", "deployment", "state", "activity", "object", "timing", "unclassified")
ELEMENT_CYCLE = ("participant", "class", "actor", "component", "node", "state", "partition", "object", "interface", "usecase")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, blob_id, file_path, content: documents as blobs; every third has both markers, every third only the first."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    ext = F.element_at(F.array(*map(F.lit, EXTENSION_CYCLE)), (F.col("doc_id") % len(EXTENSION_CYCLE) + 1).cast("int"))
    content = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("@startuml\n"), "text", F.lit("\n@EndUML"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("@startuml\n"), "text")).otherwise(F.col("text"))
    return d.select("doc_id", F.sha1(F.col("text").cast("binary")).alias("blob_id"), F.concat(F.lit("src/d"), F.col("doc_id").cast("string"), ext).alias("file_path"), content.alias("content"))


def class_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation, content: a class or interface a customer, a relation an order."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    word = F.when(F.col("c_custkey") % 3 == 0, "interface").otherwise("class")
    declared = c.select("c_nationkey", F.lit(0).alias("k"), "c_custkey", F.concat(word, F.lit(" C"), F.col("c_custkey").cast("string")).alias("line"))
    o = read(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    related = o.select("c_nationkey", F.lit(1).alias("k"), F.col("o_orderkey").alias("c_custkey"), F.concat(F.lit("C"), F.col("c_custkey").cast("string"), F.lit(" --> P"), (F.col("o_orderkey") % 50).cast("string")).alias("line"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "c_custkey", "line"))), lambda x: x["line"]), "\n")
    return declared.unionByName(related).groupBy(F.col("c_nationkey").alias("nation")).agg(F.concat(F.lit("@startuml\n"), body, F.lit("\n@enduml\n")).alias("content"))


def sequence_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grp (user_id modulo 50), content: a message an event."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    line = F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit(" -> S_"), "event_type", F.lit(" : m"), F.col("event_id").cast("string"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"]), "\n")
    return e.groupBy((F.col("user_id") % 50).alias("grp")).agg(body.alias("content"), F.count("*").alias("n"))


def component_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation, content: a bracketed component a supplier, each tied to an interface."""
    s = read(spark, sf_dir, "supplier")
    line = F.concat(F.lit("[S"), F.col("s_suppkey").cast("string"), F.lit("]\n() I"), (F.col("s_suppkey") % 7).cast("string"), F.lit("\n[S"), F.col("s_suppkey").cast("string"), F.lit("] --> I"), (F.col("s_suppkey") % 7).cast("string"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", line.alias("line")))), lambda x: x["line"]), "\n")
    return s.groupBy(F.col("s_nationkey").alias("nation")).agg(body.alias("content"))


def usecase_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """brand, content: an actor a part size, a use case a part."""
    p = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    line = F.concat(F.lit("A"), F.col("p_size").cast("string"), F.lit(" --> (Use "), F.col("p_partkey").cast("string"), F.lit(")"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", line.alias("line")))), lambda x: x["line"]), "\n")
    return p.groupBy(F.col("p_brand").alias("brand")).agg(body.alias("content"))


def multi_diagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stem, content: a file an order, a block a line item; every fifth item's block is opened twice, every seventh order ends open."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    extra = F.when(F.col("l_partkey") % 5 == 0, F.lit("@startuml\nlost\n")).otherwise("")
    block = F.concat(extra, F.lit("@startuml\nitem_"), F.col("l_partkey").cast("string"), F.lit("\n@enduml\noutside\n"))
    ordered = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", block.alias("b"))))
    body = F.array_join(F.transform(ordered, lambda x: x["b"]), "")
    tail = F.when(F.col("l_orderkey") % 7 == 0, "@startsalt\nopen\n").otherwise("")
    key = F.col("l_orderkey").cast("string")
    return li.groupBy("l_orderkey").agg(body.alias("body")).select(F.concat(F.lit("o"), key).alias("stem"), F.concat(F.lit("' order "), key, F.lit("\n\n"), "body", tail).alias("content"))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stem, line_no, value: a few long files as tables of lines, one of them with a third of all. An event gives up to seven lines, numbered
    from eight times its id: a comment, now and then a start that is lost, a start, a message, an end (every seventh: none), text outside,
    and now and then another end."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id")
    every = lambda n, text: F.when(F.col("event_id") % n == 0, F.lit(text))
    texts = [F.concat(F.lit("' note "), F.col("event_id").cast("string")), every(5, "  @startUML x"), F.lit("@startuml"), F.concat(F.lit("m"), F.col("event_id").cast("string")), F.when(F.col("event_id") % 7 != 0, F.lit("@EndUml")), F.lit("outside @startuml"), every(11, "\t@enduml")]
    stem = F.when(F.col("user_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")))
    rows = e.select(stem.alias("stem"), (F.col("event_id") * 8).alias("at"), F.posexplode(F.array(*texts)).alias("k", "value"))
    return rows.where("value IS NOT NULL").select("stem", (F.col("at") + F.col("k")).alias("line_no"), "value")


def noisy_diagrams(spark: SparkSession, sf_dir: str, noise: dict[int, str], every: int = 4) -> DataFrame:
    """grp, content: sequence lines by event, with a piece of noise before each line whose event_id % every is a key of noise."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id")
    line = F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit(" -> V : m"), F.col("event_id").cast("string"))
    piece = F.lit("")
    for k, text in noise.items():
        piece = F.when(F.col("event_id") % every == k, text).otherwise(piece)
    ordered = F.sort_array(F.collect_list(F.struct("event_id", F.concat(piece, line).alias("line"))))
    return e.groupBy((F.col("user_id") % 50).alias("grp")).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("content"))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, file_name, primary_type, confidence, elements: orders as classified diagrams, their items as elements."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    kind = F.element_at(F.array(*map(F.lit, ELEMENT_CYCLE)), (F.col("l_partkey") % len(ELEMENT_CYCLE) + 1).cast("int"))
    counts = li.groupBy("l_orderkey", kind.alias("e")).agg(F.count("*").cast("int").alias("n"))
    maps = counts.where(F.col("l_orderkey") % 11 != 0).groupBy("l_orderkey").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("e", "n")))).alias("elements"))
    o = read(spark, sf_dir, "orders").select("o_orderkey")
    kinds = F.element_at(F.array(*map(F.lit, TYPE_CYCLE)), (F.col("o_orderkey") % len(TYPE_CYCLE) + 1).cast("int"))
    joined = o.join(maps, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select(
        "o_orderkey", F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.lit(".puml")).alias("file_name"), kinds.alias("primary_type"),
        ((F.col("o_orderkey") % 10) / 10.0).alias("confidence"), F.coalesce("elements", F.create_map().cast("map<string,int>")).alias("elements"),
    )

"""A Merkle manifest of a dataset: a tree of digests for each source, a tree over their roots, and a proof for every row.

Vertices are keyed by (tree, number) and work in supersteps on RDDs, in the manner of Pregel:

1. Upward, every node that isn't the last of its tree sends its digest to its parent, number // FAN. A parent hashes once all the
   children that its tree's size promises are there, keeps their digests, and is a sender in the next superstep. A superstep is one
   shuffle of what it sends, a sixteenth of the one before; its vertices are written into the shared folder and read again.
2. The roots of the sources' trees are the leaves of one more tree, worked off in the same way.
3. Downward, every node sends each of its children what stood to its left and right and, behind it, its own path to the root. So a
   leaf's path arrives without a search; paths are made a parent at a time, and a leaf's is held only while it is folded.

Numbers within a tree: rows are range-partitioned by source and order and sorted; each run of a source in a partition starts where
the runs before it end. So a source that holds a third of all rows is spread over its share of the partitions. Rows that are equal in
every column meet in one range. Texts never leave the scan: digests alone are shuffled.

Defined results: a null field counts as `-`; rows of null source are a source of their own, which comes first; null doc_ids come first
in their source and are not tampered with; rows that share source and doc_id follow one another by leaf digest; a lone row is its
source's root, and a lone source's root is the root, with an empty proof; empty and very long texts are hashed whole; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import drop_table, release, scratch_path, table, working_tables, write_table

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A partition of a superstep takes no more messages than this where there is a choice.
MESSAGES = 200_000
#: The runs of sources in partitions are broadcast up to so many rows and bytes of source names, else joined by a shuffle.
BROADCAST_RUNS, BROADCAST_BYTES = 100_000, 8_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(c: Column) -> Column:
    """What is hashed of one field: `-`, or the number of its bytes and the value."""
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)).cast("binary"), 256)


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, nothing else. Pure ASCII texts take the built-in function, which is the faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


# ---------------------------------------------------------------- numbers within trees


def numbered(rows: DataFrame, tree: str, *order: str, keep) -> tuple[DataFrame, list[int]]:
    """rows with number long (from 0 within each tree, in the given order) and size long (of the tree); and how many nodes all trees have
    on each level, up to the one where every tree has one node."""
    spread = rows.repartitionByRange(F.col(tree), *[F.col(c) for c in order]).sortWithinPartitions(tree, *order)
    placed = keep(spread.withColumn("place", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("place", 33)
    runs = placed.groupBy(part.alias("part"), F.col(tree).alias("owner")).agg(F.min("place").alias("start"), F.count("*").alias("n"))
    one = Window.partitionBy("owner")
    before = one.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition at most
    runs = keep(runs.select("part", "owner", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(one).alias("size")), "runs")
    # a row a tree: how many nodes it has on each level that a long's size can have
    on = [F.coalesce(F.sum(F.when(F.col("base") == 0, F.expr(f"(size - 1) div {FAN**k}L + 1"))), F.lit(0)).alias(f"n{k}") for k in range(16)]
    about = runs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col("owner").cast("string"))), F.lit(0)).alias("b"), F.coalesce(F.max("size"), F.lit(0)).alias("most"), *on).first()
    runs = F.broadcast(runs) if about["n"] <= BROADCAST_RUNS and about["b"] <= BROADCAST_BYTES else runs
    at = placed.withColumn("_part", part)
    met = at.join(runs, (at["_part"] == runs["part"]) & at[tree].eqNullSafe(runs["owner"]))
    sizes = [about[f"n{k}"] for k in range(16) if k == 0 or FAN ** (k - 1) < about["most"]]
    return met.select(*rows.columns, (F.col("base") + F.col("place") - F.col("start")).alias("number"), "size"), sizes


# ---------------------------------------------------------------- supersteps


def _owner(key) -> int:
    return zlib.crc32(repr(key).encode())


def parents_of(n: int) -> int:
    return -(-n // FAN)


def by_key(messages):
    met: dict = {}
    for key, message in messages:
        met.setdefault(key, []).append(message)
    return met.items()


def deliver(messages: RDD, parts: int) -> RDD:
    """(key, message) -> (key, its messages). One shuffle, in no more tasks than asked for: each starts a worker."""
    return messages.partitionBy(parts, _owner).coalesce(parts).mapPartitions(by_key)


def send_up(vertex):
    """A vertex ((tree, number), (size, digest, *rest)) -> a message to its parent."""
    (tree, number), state = vertex
    return (tree, number // FAN), (number % FAN, state)


def complete(message):
    """A parent's key and its children's messages -> ((tree, number), (size, digest, children)), children in order."""
    (tree, number), got = message
    children = sorted(got, key=lambda c: c[0])
    size = children[0][1][0]
    if [c[0] for c in children] != list(range(min(FAN, size - FAN * number))):
        raise ValueError(f"node {number} of tree {tree!r} has children {[c[0] for c in children]} of {size}")
    states = [c[1] for c in children]
    return (tree, number), (parents_of(size), digest("".join(s[1] for s in states)), [s[1:] for s in states])


def send_down(vertex):
    """A parent with its path -> the path of each child: what stands left and right of it, then the parent's own steps."""
    (tree, number), (state, (top, steps)) = vertex
    digests = [c[0] for c in state[2]]
    for k in range(len(digests)):
        yield (tree, FAN * number + k), (top, [("".join(digests[:k]), "".join(digests[k + 1 :])), *steps])


def fold(leaf: str, steps) -> str:
    """The root that a leaf and its path give."""
    for left, right in steps:
        leaf = digest(left + leaf + right)
    return leaf


def proof(steps) -> str:
    return digest("".join(left + right for left, right in steps))


class Forest:
    """Trees worked off together. Level 0 are the leaves ((tree, number), (size of the tree, digest, *rest)); each level above is a table
    of parents in the shared folder."""

    def __init__(self, spark: SparkSession, leaves: RDD, sizes: list[int]):
        """sizes: nodes of all trees on each level, from the leaves to the level where every tree has one node."""
        self.spark, self.sizes, self.levels, self.paths = spark, sizes, [leaves], []
        for level in range(1, len(sizes)):
            sent = self.levels[-1].filter(lambda v: v[1][0] > 1).map(send_up)
            met = deliver(sent, self.parts(level - 1))  # at most FAN messages a key
            self.levels.append(self.keep(met.map(complete), f"level-{level}", level))

    def parts(self, level: int) -> int:
        """Partitions for the messages of a level."""
        n, usual = self.sizes[level], int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return max(min(usual, n // 2000 + 1), n // MESSAGES + 1)

    def keep(self, vertices: RDD, name: str, level: int) -> RDD:
        """Writes a level's vertices into the shared folder and reads them in as many partitions as the level's size asks for."""
        path = scratch_path(self.spark, name)
        vertices.saveAsPickleFile(path)
        self.paths.append(path)
        return self.spark.sparkContext.pickleFile(path).coalesce(self.parts(level))

    def roots(self) -> RDD:
        """(tree, level, digest) of every tree."""
        tops = [nodes.filter(lambda v: v[1][0] == 1).map(lambda v, k=k: (v[0][0], k, v[1][1])) for k, nodes in enumerate(self.levels)]
        return self.spark.sparkContext.union(tops)

    def meet(self, vertices: RDD, paths: RDD, parts: int) -> RDD:
        """(key, state) and (key, path) -> (key, (state, path)); keys occur once on either side."""
        both = vertices.mapValues(lambda v: (0, v)).union(paths.mapValues(lambda p: (1, p)))
        return deliver(both, parts).mapValues(lambda got: tuple(v for _, v in sorted(got, key=lambda x: x[0])))

    def descend(self, tops: RDD) -> RDD:
        """tops: (tree, level of its root, what every leaf of the tree is told, steps above its root) -> (told, rest of the leaf's state,
        steps) of every leaf."""
        begin = lambda level: tops.filter(lambda t: t[1] == level).map(lambda t: ((t[0], 0), (t[2], t[3])))
        lone = self.meet(self.levels[0].filter(lambda v: v[1][0] == 1), begin(0), self.parts(0)).map(lambda v: (v[1][1][0], v[1][0][1:], v[1][1][1]))
        paths = None
        for level in range(len(self.levels) - 1, 0, -1):
            here = begin(level) if paths is None else paths.union(begin(level))
            met = self.meet(self.levels[level], here, self.parts(level - 1))
            if level == 1:
                told = met.flatMap(lambda v: [(top, child, steps) for child, (_, (top, steps)) in zip(v[1][0][2], send_down(v))])
                return told.union(lone)
            paths = self.keep(met.flatMap(send_down), f"paths-{level - 1}", level - 1)
        return lone


# ---------------------------------------------------------------- manifest


def leaves(documents: DataFrame) -> DataFrame:
    """source, doc_id, leaf: the digest of every row."""
    return documents.select("source", "doc_id", leaf_digest(*[F.col(c) for c in FIELDS]).alias("leaf"))


def verify(claims: DataFrame) -> DataFrame:
    """source, doc_id, leaf, claim (the digest that the row's present content gives; null: the same as leaf) -> doc_id, leaf, subroot, root,
    proof_sha256, folded_root (of the claim and the leaf's path), verified boolean."""
    spark = claims.sparkSession
    with working_tables(spark) as keep:
        digests = keep(claims.select("source", "doc_id", "leaf", "claim"), "digests")  # texts are read once
        rows, sizes = numbered(digests, "source", "doc_id", "leaf", keep=keep)
        state = rows.rdd.map(lambda r: ((r["source"], r["number"]), (r["size"], r["leaf"], r["doc_id"], r["claim"])))
        kind = claims.schema["doc_id"].dataType
        schema = T.StructType([T.StructField("doc_id", kind), *T.StructType.fromDDL("leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean").fields])
        if not sizes[0]:
            return spark.createDataFrame([], schema)
        forest = Forest(spark, state, sizes)
        # the second tree: over the sources' roots, which are as many as there are sources
        subroots = spark.createDataFrame(forest.roots(), T.StructType([T.StructField("source", claims.schema["source"].dataType), *T.StructType.fromDDL("level int, subroot string").fields]), verifySchema=False)
        upper, above = numbered(subroots.withColumn("all", F.lit(0)), "all", "source", keep=keep)
        crown = Forest(spark, upper.rdd.map(lambda r: ((0, r["number"]), (r["size"], r["subroot"], r["source"], r["level"]))), above)
        ((_, height, root),) = crown.roots().collect()  # one tree
        told = crown.descend(spark.sparkContext.parallelize([(0, height, None, [])], 1))
        tops = forest.keep(told.map(lambda t: (t[1][1], t[1][2], t[1][0], t[2])), "tops", len(sizes) - 1)

        def row(leaf):
            subroot, (own, doc_id, claim), steps = leaf
            folded = fold(claim or own, steps)
            return doc_id, own, subroot, root, proof(steps), folded, folded == root

        out = write_table(spark.createDataFrame(forest.descend(tops).map(row), schema, verifySchema=False), "proofs")
        for path in (*forest.paths, *crown.paths):
            drop_table(spark, path)
    release(spark)
    return spark.read.schema(schema).parquet(out)


def tampered(documents: DataFrame) -> DataFrame:
    """source, doc_id, leaf, claim: the digest of the row with its text in lower case where 5 divides the id's crc32, else null."""
    changed = [lower_ascii(F.col("text")) if c == "text" else F.col(c) for c in FIELDS]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return documents.select("source", "doc_id", leaf_digest(*[F.col(c) for c in FIELDS]).alias("leaf"), F.when(chosen, leaf_digest(*changed)).alias("claim"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify(tampered(table(spark, sf_dir, "documents").select(*FIELDS)))


def _oracle() -> str:
    """The same in SQL: the nodes of all levels, then each leaf's way to the root, folded level by level."""

    def leaf(text: str) -> str:
        value = [f"{text if c == 'text' else c}::VARCHAR" for c in FIELDS]
        return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in value) + ")"

    def nodes(name: str, first: str) -> str:
        return f"""{name} AS (SELECT 0 AS level, * FROM ({first}) UNION ALL
  SELECT level + 1, tree, number // {FAN}, (size + {FAN - 1}) // {FAN}, sha256(string_agg(digest, '' ORDER BY number)) FROM {name} WHERE size > 1 GROUP BY level, tree, number // {FAN}, size)"""

    def walk(name: str, over: str, first: str) -> str:
        return f"""{name} AS (SELECT 0 AS level, * FROM ({first}) UNION ALL
  SELECT w.level + 1, w.rid, w.tree, w.number // {FAN}, (w.size + {FAN - 1}) // {FAN}, sha256(string_agg(CASE WHEN n.number = w.number THEN w.folded ELSE n.digest END, '' ORDER BY n.number)),
    w.proof || coalesce(string_agg(n.digest, '' ORDER BY n.number) FILTER (WHERE n.number <> w.number), '')
  FROM {name} w JOIN {over} n ON n.level = w.level AND n.tree = w.tree AND n.number // {FAN} = w.number // {FAN} WHERE w.size > 1 GROUP BY w.level, w.rid, w.tree, w.number, w.size, w.proof)"""

    # crc32 of a short text, a bit at a time
    bits = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda c, v: xor(xor(c, v) >> 1, 3988292384 * (xor(c, v) & 1))), 4294967295)"
    steps = [
        f"d AS MATERIALIZED (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS claim FROM documents)",
        """l AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, leaf, coalesce(claim, leaf) AS folded, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS number, count(*) OVER (PARTITION BY source) AS size FROM d)""",
        nodes("n1", "SELECT tree, number, size, leaf AS digest FROM l"),
        walk("w1", "n1", "SELECT rid, tree, number, size, folded, '' AS proof FROM l"),
        nodes("n2", "SELECT 0 AS tree, tree AS number, count(*) OVER () AS size, digest FROM n1 WHERE size = 1"),
        walk("w2", "n2", "SELECT rid, 0 AS tree, tree AS number, (SELECT count(*) FROM n1 WHERE size = 1) AS size, folded, proof FROM w1 WHERE size = 1"),
    ]
    return "WITH RECURSIVE " + ",\n".join(steps) + """
SELECT doc_id, leaf, n1.digest AS subroot, n2.digest AS root, sha256(proof) AS proof_sha256, w2.folded AS folded_root, w2.folded = n2.digest AS verified
FROM l JOIN n1 ON n1.tree = l.tree AND n1.size = 1 JOIN w2 ON w2.rid = l.rid AND w2.size = 1 JOIN n2 ON n2.size = 1"""


ORACLE = _oracle()

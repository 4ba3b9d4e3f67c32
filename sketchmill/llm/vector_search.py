"""Nearest neighbours with one vantage-point tree per shard.

A shard is a run of at most SHARD_ROWS vectors of one dimension out of one input partition, so indexing every row needs no
shuffle; its tree and vectors are written to the shared folder as one row. A node keeps, for either child, the smallest and the
largest distance to its vantage point; the triangle inequality bounds from below the distance of a query to all of a child's
vectors, and the child is skipped if `factor` times that bound exceeds the query's k-th best distance so far. Factor 1 is exact
search; larger factors skip more and may lose neighbours. The registered query uses factor 1.

Queries are a stated set and are worked off in blocks of about QUERY_BYTES, each in one pass over all shards. They are written once,
by block, so a block reads its own queries only. A task carries its best lists from shard to shard and sends k rows a query; the
lists of all tasks meet in a window that keeps k rows map-side as well.

Defined results: null, empty and zero vectors, vectors holding null or non-finite components, and rows with a null id take no
part; only vectors of equal dimension are compared; repeated rows are candidates one by one, repeated query rows count once; with
fewer than k candidates all are returned; ties go to the smaller id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_table, scratch_path, table, write_table

SHARD_ROWS = 8192
LEAF_ROWS = 64
#: Of one block's queries and their best lists, as every task holds them.
QUERY_BYTES = 64_000_000
FACTOR = 1.0
K = 10


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, components added in their order. a: [n, dim], b: [m, dim] -> [n, m]."""
    total = np.zeros((len(a), len(b)))
    at, bt = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    for x, y in zip(at, bt):
        gap = x[:, None] - y[None, :]
        gap *= gap
        total += gap
    return np.sqrt(total, out=total)


class VantageTree:
    """Nodes in arrays; a leaf is a run of rows. Vantage points are chosen by a fixed generator, so a rebuilt shard is the same."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.nodes: list[tuple] = []  # (vantage row, inside, outside, lo/hi of inside, lo/hi of outside) or (first, past last)
        order = np.arange(len(ids))
        rng = np.random.default_rng(len(ids))
        wide = vectors.astype(np.float64)

        def build(lo: int, hi: int) -> int:
            place = len(self.nodes)
            self.nodes.append(())
            if hi - lo <= LEAF_ROWS:
                self.nodes[place] = (lo, hi)
                return place
            pick = int(rng.integers(lo, hi))
            order[[lo, pick]] = order[[pick, lo]]
            rest = order[lo + 1 : hi]
            d = distances(wide[order[lo]][None], wide[rest])[0]
            by = np.argsort(d, kind="stable")
            order[lo + 1 : hi], d = rest[by], d[by]
            mid = len(d) // 2
            bounds = (d[0], d[mid - 1], d[mid], d[-1])
            inside = build(lo + 1, lo + 1 + mid)
            outside = build(lo + 1 + mid, hi)
            self.nodes[place] = (lo, inside, outside, *bounds)
            return place

        build(0, len(ids))
        self.vectors, self.ids = vectors[order], ids[order]

    def search(self, queries: np.ndarray, own: np.ndarray, best_d: np.ndarray, best_id: np.ndarray, factor: float) -> None:
        """Improves the best lists (distance, id; ascending) of all queries in place."""
        wide = self.vectors.astype(np.float64)

        def offer(q: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
            d = np.where(ids[None, :] == own[q][:, None], np.inf, d)
            some = (d <= best_d[q, -1][:, None]).any(1)
            q, d = q[some], d[some]
            if not len(q):
                return
            all_d = np.concatenate([best_d[q], d], 1)
            all_id = np.concatenate([best_id[q], np.broadcast_to(ids, d.shape)], 1)
            keep = np.lexsort((all_id, all_d), axis=1)[:, : best_d.shape[1]]
            best_d[q], best_id[q] = np.take_along_axis(all_d, keep, 1), np.take_along_axis(all_id, keep, 1)

        def visit(node: int, q: np.ndarray) -> None:
            if not len(q):
                return
            at = self.nodes[node]
            if len(at) == 2:
                for lo in range(0, len(q), 512):
                    part = q[lo : lo + 512]
                    offer(part, distances(queries[part], wide[at[0] : at[1]]), self.ids[at[0] : at[1]])
                return
            row, inside, outside, in_lo, in_hi, out_lo, out_hi = at
            d = distances(queries[q], wide[row : row + 1])
            offer(q, d, self.ids[row : row + 1])
            d = d[:, 0]
            middle = (in_hi + out_lo) / 2

            def alive(lo: float, hi: float, some: np.ndarray) -> np.ndarray:
                x = d[some]
                bound = np.maximum(np.maximum(x - hi, lo - x), 0) - 1e-12 * (x + hi)  # rounding must not prune
                return some[~(factor * bound > best_d[q[some], -1])]

            near, far = np.flatnonzero(d <= middle), np.flatnonzero(d > middle)
            visit(inside, q[alive(in_lo, in_hi, near)])
            visit(outside, q[alive(out_lo, out_hi, near)])
            visit(outside, q[alive(out_lo, out_hi, far)])
            visit(inside, q[alive(in_lo, in_hi, far)])

        visit(0, np.arange(len(queries)))


def usable(ids, column) -> list[tuple[np.ndarray, np.ndarray]]:
    """An Arrow id and list column as (ids, matrix) by dimension, without the rows that take no part."""
    import pyarrow as pa
    import pyarrow.compute as pc

    keep = pc.and_(pc.is_valid(ids), pc.is_valid(column))
    ids, column = ids.filter(keep), column.filter(keep)
    if not len(ids):
        return []
    key = np.asarray(ids.cast(pa.int64()))
    lengths = np.asarray(pc.list_value_length(column)).astype(np.int64)
    values = column.flatten()
    values = values.cast(pa.float32() if pa.types.is_float32(values.type) else pa.float64(), safe=False).to_numpy(zero_copy_only=False)
    first = np.append(0, np.cumsum(lengths))[:-1]
    out = []
    for dim in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == dim)
        m = values[first[rows][:, None] + np.arange(dim)]
        ok = np.isfinite(m).all(1) & (m != 0).any(1)
        if ok.any():
            out.append((key[rows[ok]], m[ok]))
    return out


def build_index(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> str:
    """Writes one row a shard and returns the path."""

    def shard(batches):
        import pyarrow as pa

        held: dict[int, list] = {}

        def made(dim: int, ids: np.ndarray, m: np.ndarray):
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([pickle.dumps(VantageTree(m, ids))], pa.binary())], ["dim", "n", "tree"])

        for batch in batches:
            for ids, m in usable(batch.column(0), batch.column(1)):
                dim = m.shape[1]
                held.setdefault(dim, []).append((ids, m))
                if sum(len(i) for i, _ in held[dim]) >= SHARD_ROWS:
                    ids, m = (np.concatenate(x) for x in zip(*held[dim]))
                    whole = len(ids) // SHARD_ROWS * SHARD_ROWS
                    for lo in range(0, whole, SHARD_ROWS):
                        yield made(dim, ids[lo : lo + SHARD_ROWS], m[lo : lo + SHARD_ROWS])
                    held[dim] = [(ids[whole:], m[whole:])]
        for dim, parts in held.items():
            ids, m = (np.concatenate(x) for x in zip(*parts))
            if len(ids):
                yield made(dim, ids, m)

    return write_table(vectors.select(id_column, column).mapInArrow(shard, "dim int, n long, tree binary"), "vector-index", "none")


def search_index(spark: SparkSession, path: str, ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> DataFrame:
    """The k nearest of each query of one block: query_id, vec_id, score."""
    shared, dim = spark.sparkContext.broadcast((ids, queries)), queries.shape[1]  # about QUERY_BYTES

    def search(batches):
        import pyarrow as pa

        own, wide = shared.value[0], shared.value[1].astype(np.float64)
        best_d, best_id = np.full((len(own), k), np.inf), np.full((len(own), k), np.iinfo(np.int64).max)
        for batch in batches:
            for raw in batch.column(0):
                pickle.loads(raw.as_py()).search(wide, own, best_d, best_id, factor)
        q, r = np.nonzero(np.isfinite(best_d))
        yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(best_id[q, r]), pa.array(best_d[q, r])], ["query_id", "vec_id", "score"])

    shards = spark.read.parquet(path).where(F.col("dim") == dim).select("tree")
    found = shards.mapInArrow(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id long, rank int, vec_id long, score double for every usable row of queries against every usable row of vectors but its own id."""
    spark = vectors.sparkSession
    path = build_index(vectors, id_column, column)
    asked = queries.select(id_column, column).where(F.col(id_column).isNotNull())
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size(column)), F.lit(0)).alias("dim")).first()
    blocks = max(1, -(-size["n"] * (8 * max(size["dim"], 1) + 16 * k) // QUERY_BYTES))
    if blocks > 1:
        stored = scratch_path(spark, "queries")
        asked.withColumn("block", F.pmod(F.xxhash64(id_column), F.lit(blocks))).write.partitionBy("block").parquet(stored)
        asked = spark.read.parquet(stored)
    out = None
    for b in range(blocks):
        part = asked.where(F.col("block") == b).drop("block") if blocks > 1 else asked
        for ids, m in usable_rows(part):
            ids, first = np.unique(ids, return_index=True)
            found = search_index(spark, path, ids, m[first], k, factor)
            if blocks > 1:  # many blocks: each block's rows are kept at once, so the plan stays small
                out = out or scratch_path(spark, "neighbours")
                found.write.mode("append").parquet(out)
            else:
                out = found if out is None else out.unionByName(found)
    if blocks > 1:
        drop_table(spark, stored)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = spark.read.parquet(out) if isinstance(out, str) else out
    return out.select("query_id", "rank", "vec_id", "score")


def usable_rows(block: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """One block of queries, fetched."""
    t = block.toArrow().combine_chunks()
    return usable(t.column(0).combine_chunks(), t.column(1).combine_chunks()) if t.num_rows else []


def op8_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))


ORACLE = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

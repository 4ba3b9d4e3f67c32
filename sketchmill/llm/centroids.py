"""Centroid clustering of vectors on integers, with exact results whatever the partitions.

1. Vectors become integers, floor(scale * x) a component, as one binary value; equal ones are grouped into one row with their
   multiplicity (summed map-side, so that a vector that a third of the rows hold is a row a task).
2. Lloyd's rounds run over the distinct vectors: tasks assign them and send, a cluster, a count and componentwise integer sums
   weighted by multiplicity; Spark adds these up, and the driver holds the centroids alone.
3. The last assignment is joined back to the rows. Rows are salted by vec_id; a distinct vector is repeated for the salts that its
   rows have (at most SALTS), so that the rows of a common vector are dealt out.

All sums and distances are integers, so nothing depends on their order.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no part and give no row;
repeated rows and repeated vec_ids count each and give a row each; vectors of null vec_id are clustered like others and start
centroids only where there are too few others; of equal hashes, the smaller bytes go first; with fewer vectors than centroids
there is a centroid a vector; components beyond +-REACH after scaling are held at it, as a long has no room for their squares; an
inertia past a long's largest value is that value; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import extended, table, write_table

DIMENSIONS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256.0, "2:"
#: Largest magnitude of a component: the squared distance of two vectors of 64 components then fits a long.
REACH = 1 << 27
#: Up to this magnitude, products of 64 components are exact in double precision.
EXACT = 1 << 20
SALTS = 256
#: Vectors of a batch are assigned in runs of so many.
RUN = 8192
_LONG = "9223372036854775807"


def quantise(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: float = SCALE) -> DataFrame:
    """vec_id, q binary: the components as little-endian int32, of the vectors that take part."""

    def floor(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            whole = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dimensions), False)
            rows = batch.filter(whole)
            x = rows.column(1).flatten()
            x = np.asarray(x.cast(pa.float64()).fill_null(float("nan"))).reshape(-1, dimensions)
            fine = np.isfinite(x).all(axis=1)
            q = np.clip(np.floor(scale * x[fine].clip(-REACH, REACH)), -REACH, REACH).astype("<i4")
            yield pa.RecordBatch.from_arrays([rows.column(0).filter(pa.array(fine)), pa.array([r.tobytes() for r in q], pa.binary())], ["vec_id", "q"])

    return vectors.select("vec_id", "embedding").mapInArrow(floor, extended(vectors.select("vec_id"), "q binary"))


def salt(vec_id: Column) -> Column:
    return F.pmod(F.xxhash64(vec_id), F.lit(SALTS)).cast("int")


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, q -> q, weight long, salts array<int>: each different vector with its multiplicity and the salts of its rows."""
    counted = rows.groupBy("q", salt(F.col("vec_id")).alias("salt")).agg(F.count("*").alias("n"))
    return counted.groupBy("q").agg(F.sum("n").alias("weight"), F.collect_list("salt").alias("salts"))


def integers(column) -> np.ndarray:
    """An Arrow column of q as an array of rows of int64."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), "<i4").reshape(len(values), -1).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid (of equals the smallest) and the squared distance, in exact integers."""
    small = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0))) <= EXACT
    c = centroids.astype(np.float64) if small else centroids
    own = (centroids * centroids).sum(axis=1)
    cluster, distance = np.empty(len(x), np.int32), np.empty(len(x), np.int64)
    for i in range(0, len(x), RUN):
        part = x[i : i + RUN]
        cross = (part.astype(np.float64) @ c.T).astype(np.int64) if small else part @ c.T
        far = own[None, :] - 2 * cross
        best = far.argmin(axis=1)
        cluster[i : i + RUN] = best
        distance[i : i + RUN] = far[np.arange(len(part)), best] + (part * part).sum(axis=1)
    return cluster, distance


def first_centroids(rows: DataFrame, k: int = CENTROIDS, seed: str = SEED) -> np.ndarray:
    """The vectors whose vec_ids have the k smallest hashes, in that order."""
    key = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    got = rows.select(key.alias("h"), "q").orderBy(F.asc_nulls_last("h"), "q").limit(k).collect()  # k vectors
    return np.frombuffer(b"".join(r["q"] for r in got), "<i4").astype(np.int64).reshape(len(got), -1) if got else np.zeros((0, 0), np.int64)


def sums_by_cluster(distinct: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """cluster -> its rows and their componentwise sums, each distinct vector with its weight."""
    k, d = centroids.shape

    def partial(batches):
        import pyarrow as pa

        n, total = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, weight = integers(batch.column(0)), np.asarray(batch.column(1))
            cluster, _ = nearest(x, centroids)
            order = np.argsort(cluster, kind="stable")
            at = np.flatnonzero(np.r_[True, np.diff(cluster[order]) > 0])
            own = cluster[order][at]
            n[own] += np.add.reduceat(weight[order], at)
            total[own] += np.add.reduceat((x * weight[:, None])[order], at, axis=0)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n[own]), pa.array(total[own].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    sent = distinct.select("q", "weight").mapInArrow(partial, "cluster int, n long, sums array<long>")
    wide = lambda c: F.sum(c.cast("decimal(38,0)"))
    met = sent.groupBy("cluster").agg(wide(F.col("n")).alias("n"), F.array(*[wide(F.get("sums", F.lit(i))) for i in range(d)]).alias("sums"))
    return {r["cluster"]: (int(r["n"]), [int(s) for s in r["sums"]]) for r in met.collect()}  # a row a centroid


def lloyd(distinct: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after so many rounds: each becomes the floor of its vectors' mean; one without vectors stays."""
    for _ in range(rounds if len(centroids) else 0):
        after = centroids.copy()
        for cluster, (n, sums) in sums_by_cluster(distinct, centroids).items():
            after[cluster] = [s // n for s in sums]
        if (after == centroids).all():
            break  # further rounds would give the same
        centroids = after
    return centroids


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """distinct with cluster int, distance long."""

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                cluster, distance = nearest(integers(batch.column("q")), centroids)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster), pa.array(distance)], names=[*batch.schema.names, "cluster", "distance"])

    return distinct.mapInArrow(assign, extended(distinct, "cluster int, distance long"))


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: float = SCALE, seed: str = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, q, cluster int, distance long of every vector that takes part; cluster int, n, cluster_inertia and inertia long,
    centroid array<long>, centroid_sha256 of every cluster that has vectors)."""
    spark = vectors.sparkSession
    rows = spark.read.parquet(write_table(quantise(vectors, dimensions, scale), "quantised"))
    distinct = spark.read.parquet(write_table(distinct_vectors(rows), "distinct-vectors"))
    centroids = lloyd(distinct, first_centroids(rows, k, seed), rounds)
    done = spark.read.parquet(write_table(assigned(distinct, centroids), "assigned"))
    dealt = done.select("q", F.explode("salts").alias("salt"), "cluster", "distance")
    back = rows.withColumn("salt", salt(F.col("vec_id"))).join(dealt, ["q", "salt"]).select("vec_id", "q", "cluster", "distance")
    wide = F.sum(F.col("distance").cast("decimal(38,0)") * F.col("weight"))
    sums = {r["cluster"]: r for r in done.groupBy("cluster").agg(wide.alias("inertia"), F.sum("weight").alias("n")).collect()}  # a row a centroid
    held = lambda x: min(int(x), int(_LONG))
    inertia = held(sum(int(r["inertia"]) for r in sums.values()))
    found = [(c, r["n"], held(r["inertia"]), inertia, centroids[c].tolist(), centroid_digest(centroids[c])) for c, r in sorted(sums.items())]
    return back, spark.createDataFrame(found, "cluster int, n long, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, clusters = cluster(table(spark, sf_dir, "embeddings"))
    about = F.broadcast(clusters.select("cluster", "cluster_inertia", "inertia", "centroid_sha256"))  # a row a centroid
    return rows.join(about, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(rounds: int = ROUNDS, k: int = CENTROIDS, dimensions: int = DIMENSIONS) -> str:
    """The same in SQL: components unnested, distances summed pair by pair."""
    steps = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, q FROM (SELECT sha256('{SEED}' || vec_id) AS h, q FROM kept ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        # d * 64 + c: the least distance, of equals the smaller number
        pairs = f"SELECT rid, vec_id, kept.q, min(list_sum(list_transform(list_zip(kept.q, c{r}.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT * {CENTROIDS} + c) AS m FROM kept, c{r} GROUP BY ALL"
        steps.append(f"a{r} AS MATERIALIZED (SELECT rid, vec_id, q, m % {CENTROIDS} AS c, m // {CENTROIDS} AS d FROM ({pairs}))")
        if r < rounds:
            steps.append(f"s{r} AS (SELECT c, i, sum(q[i]) AS s, count(*) AS n FROM a{r}, range(1, {dimensions + 1}) t(i) GROUP BY c, i)")
            steps.append(f"m{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS q FROM s{r} GROUP BY c)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(m{r}.q, c{r}.q) AS q FROM c{r} LEFT JOIN m{r} USING (c))")
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c{rounds}.q, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"""
    )


ORACLE = _oracle()

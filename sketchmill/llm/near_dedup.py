"""Near-duplicates: one-permutation hashing with optimal densification, banded buckets and star-shaped candidate edges.

A document's set: its distinct SHINGLE-word shingles (64-bit hashes), or the whole sequence as one where it has fewer words. Links:
100 * |intersection| >= 85 * |union|.

1. Per document: size, a 128-bit fingerprint of the set, and BANDS bucket keys of ROWS bins each. One hash splits a set into
   BANDS * ROWS bins (Li et al. 2012); empty bins borrow from bins drawn by a hash of (bin, attempt) alone (Shrivastava 2017).
2. Documents with equal sets become one node, so thousands of copies are one row from here on.
3. Each bucket links its members to one centre only, the node with most company: a star, so edges grow with members, not with pairs.
4. Every edge is confirmed on full sets, which are made again from the text of the nodes that have edges.
5. Components of confirmed edges. A bucket whose members are then still in several components may hide a link between two
   members that both missed the star's centre. All nodes of such buckets, whatever their size, are settled exactly by one
   prefix-filtered join between different components (`open_pairs`), whose pairs are confirmed on full sets. Components only merge,
   so one pass leaves no pair open. A link is lost only if its two documents share no bucket and no chain of other links joins them.

A pair at the threshold misses all buckets with probability (1 - 0.85^ROWS)^BANDS = 6e-9; two documents in one component need no
link of their own. No constant but BANDS and ROWS can change a result.

Defined results: null or empty text has size 0, no links and is its own component; repeated rows are copies; a null doc_id takes
part, but never names a component that has other ids; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED_WORD, extended, mix, slices, spans, string_buffers, table, word_hashes, working_tables, write_table
from .components import connected_components

SHINGLE = 5
BANDS, ROWS = 40, 6
NUMERATOR, DENOMINATOR = 85, 100
#: Rows of one key that a task takes at most: postings of a token, edges of a star's centre. Longer lists are dealt into parts.
PART = 512
#: Sizes under this are told apart one by one where sets are joined by size, larger ones by classes of a fixed ratio.
FINE_SIZES = 64


# ---------------------------------------------------------------- sets and sketches


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    start, end, first = spans(data, offsets, SPACED_WORD)
    words = word_hashes(data, start, end)
    odd = [np.uint64(pow(0x9E3779B97F4A7C15 | 1, k + 1, 1 << 64)) for k in range(size)]
    n = max(len(words) - size + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for k in range(size):
        rolled += words[k : k + n] * odd[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            few = words[a:b]
            with np.errstate(over="ignore"):
                out.append(mix(np.array([sum((w * odd[k] for k, w in enumerate(few)), np.uint64(b - a))], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@functools.lru_cache(maxsize=64)
def _detour(attempt: int, bins: int) -> np.ndarray:
    """Where each empty bin looks at this attempt; the same for every document."""
    return (mix(np.arange(bins, dtype=np.uint64) + np.uint64((attempt + 1) * 0x517CC1B727220A95 % (1 << 64))) % np.uint64(bins)).astype(np.int64)


def bucket_keys(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """[sets, bands] keys; the sets are not empty."""
    bins = bands * rows
    lengths = np.array([len(s) for s in sets])
    h = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), lengths)
    # sorted within a set, so the first hash of each bin is its least
    bin_ = (((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    flat = row * bins + bin_
    lead = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    value = np.zeros(len(sets) * bins, np.uint64)
    full = np.zeros(len(sets) * bins, bool)
    value[flat[lead]], full[flat[lead]] = h[lead], True
    had = full.copy()
    empty = np.flatnonzero(~full)
    attempt = 0
    while len(empty):
        at = empty - empty % bins + _detour(attempt, bins)[empty % bins]
        ok = had[at]
        value[empty[ok]] = value[at[ok]]
        empty = empty[~ok]
        attempt += 1
    value = mix(value).reshape(len(sets), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(sets), bands)).copy()
    for k in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + value[:, :, k])
    return key.view(np.int64)


def fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit sums of a set."""
    lengths = np.array([len(s) for s in sets])
    h = np.concatenate(sets)
    first = np.append(0, np.cumsum(lengths))[:-1]
    a = np.add.reduceat(mix(h ^ np.uint64(0xA5A5A5A55A5A5A5A)), first)
    b = np.add.reduceat(mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)), first)
    return mix(a).view(np.int64), mix(b).view(np.int64)


def sketch(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n long, text_hash long, f1 long, f2 long, keys array<long>; an empty set has null fingerprints and no keys."""
    kept = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")

    def make(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = string_buffers(batch.column(2))
            for i, j, part, off in slices(data, offsets):
                sets = shingle_sets(part, off, shingle)
                n = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(n)
                f1, f2, keys = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64), np.zeros((0, BANDS), np.int64)
                if len(some):
                    chosen = [sets[k] for k in some]
                    f1[some], f2[some] = fingerprints(chosen)
                    keys = np.concatenate([bucket_keys(chosen[k : k + 256]) for k in range(0, len(chosen), 256)])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(n > 0, BANDS, 0))).astype(np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], batch.column(1)[i:j], pa.array(n), pa.array(f1, mask=n == 0), pa.array(f2, mask=n == 0), lists],
                    ["doc_id", "text_hash", "n", "f1", "f2", "keys"],
                )

    return kept.mapInArrow(make, extended(kept.drop("text"), "n long, f1 long, f2 long, keys array<long>"))


def full_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """node, text -> node, n long, grams array<long>: the whole set."""

    def make(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = string_buffers(batch.column(1))
            for i, j, part, off in slices(data, offsets):
                sets = shingle_sets(part, off, shingle)
                n = np.array([len(s) for s in sets], np.int64)
                ends = np.append(0, np.cumsum(n)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], ["node", "n", "grams"])

    return rows.select("node", "text").mapInArrow(make, "node long, n long, grams array<long>")


# ---------------------------------------------------------------- candidates and links


def sizes_allow(x: Column, y: Column) -> Column:
    """No link can join sets whose sizes differ more than this."""
    return DENOMINATOR * F.least(x, y) >= NUMERATOR * F.greatest(x, y)


def bucket_members(nodes: DataFrame) -> DataFrame:
    """key, node, n, m, hub: the buckets of two nodes at least; m is a bucket's size, hub the summed size of a node's buckets."""
    in_bands = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = in_bands.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    members = in_bands.join(shared, "key")
    hubs = members.groupBy("node").agg(F.sum("m").alias("hub"))
    return members.join(hubs, "node").select("key", "node", "n", "m", "hub")


def star_edges(members: DataFrame) -> DataFrame:
    """a (the bucket's centre: the node with most company), b (every other member); distinct, as of two nodes the same one is the
    centre in all their buckets. The text that copies were made from shares most buckets with them, so it is the likeliest to be
    linked with all of them."""
    centre = members.groupBy("key").agg(F.max(F.struct("hub", "node", "n")).alias("c"))
    joined = members.join(centre, "key").where(F.col("node") != F.col("c.node")).where(sizes_allow(F.col("n"), F.col("c.n")))
    return joined.select(F.col("c.node").alias("a"), F.col("node").alias("b")).distinct()


def _name(text_hash: str) -> list[Column]:
    """An id and a text as two keys that are never null."""
    return [F.xxhash64("doc_id", text_hash).alias("name"), F.col(text_hash).alias("hash")]


def sets_of(wanted: DataFrame, documents: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """wanted: node, distinct -> node, n long, grams array<long>, made again from one text of each node."""
    named = nodes.join(wanted, "node", "left_semi").select("node", *_name("text_hash"))
    texts = documents.select("doc_id", "text", F.xxhash64("text").alias("hash")).select("text", *_name("hash"))
    found = texts.join(named, ["name", "hash"]).dropDuplicates(["name", "hash"])  # repeated rows of one id and text
    return full_sets(found, shingle)


def confirm(edges: DataFrame, documents: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """The edges (a, b) that are links, judged on full sets. a may be the centre of many edges: these are dealt into parts of about PART,
    each with a copy of the centre's set, so that every edge ships one set and no task gets a whole star."""
    ends = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    sets = sets_of(ends, documents, nodes, shingle)
    parts = edges.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = edges.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    members = dealt.join(sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("grams").alias("g_b")), "b")
    centres = sets.join(parts, F.col("node") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("n").alias("n_a"), F.col("grams").alias("g_a"))
    both = F.size(F.array_intersect("g_a", "g_b"))
    pairs = members.join(centres, ["a", "part"])
    return pairs.where(DENOMINATOR * both >= NUMERATOR * (F.col("n_a") + F.col("n_b") - both)).select("a", "b").distinct()


def open_nodes(members: DataFrame, components: DataFrame) -> DataFrame:
    """node, n, root: the nodes in a bucket whose members are in several components."""
    rooted = members.join(components, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    return rooted.join(split, "key", "left_semi").select("node", "n", "root").distinct()


def common_least(n_a: Column, n_b: Column) -> Column:
    """Shingles that two sets of these sizes share at least if they are linked."""
    return F.ceil(NUMERATOR * (n_a + n_b) / F.lit(float(NUMERATOR + DENOMINATOR)) - 1e-9)


def size_class(n: Column) -> Column:
    return F.when(n < FINE_SIZES, n).otherwise(FINE_SIZES + F.floor(F.log(n / float(FINE_SIZES)) * FINE_SIZES)).cast("int")


def prefixes(sets: DataFrame) -> DataFrame:
    """sets: node, n, root, grams -> node, n, root, t (shingle), at (its place in the set, from 0): a prefix of each set in one order of
    all shingles, such that the first common shingle of any link between two components is in both prefixes.

    A shingle that one component alone holds can be in no such link: those come first in the order, and a set with too few others is
    left out. The others are ordered by how many sets hold them, the rarest first.
    """
    grams = sets.select("node", "n", "root", F.explode("grams").alias("t"))
    crossing = grams.groupBy("t").agg(F.count("*").alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("t", "df")
    held = grams.join(crossing, "t").groupBy("node", "n", "root").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("held"))
    own, least = F.col("n") - F.size("held"), F.ceil(F.col("n") * NUMERATOR / F.lit(float(DENOMINATOR)) - 1e-9)
    longest = (F.col("n") - least - own + 1).cast("int")  # places 0 .. n - least, without those of its own
    some = held.withColumn("own", own).withColumn("longest", longest).where("longest > 0")
    some = some.select("node", "n", "root", "own", F.posexplode(F.slice("held", F.lit(1), F.col("longest"))).alias("k", "x"))
    return some.select("node", "n", "root", F.col("x.t").alias("t"), (F.col("own") + F.col("k")).alias("at"))


def open_pairs(postings: DataFrame) -> DataFrame:
    """postings: of `prefixes` -> a, b: pairs of different components that may be links by sizes and places; all links are among them.

    The smaller set of a pair goes by its own size class, the larger one to each class that its place allows: at place `at` a set of
    size n shares n - at shingles at most, which bounds the other's size. Of each shingle's list, sets outside its largest
    component meet all others, so a large component's members don't meet each other. Long lists are dealt into parts.
    """
    total, left = float(NUMERATOR), float(DENOMINATOR)
    whole = postings.groupBy("t", "root").count().groupBy("t").agg(F.max(F.struct("count", "root"))["root"].alias("main"))
    rows = postings.join(whole, "t").withColumn("out", F.col("root") != F.col("main"))
    # common_least(n, n) is the least of any partner at least as large
    small = rows.where(F.col("at") <= F.col("n") - common_least(F.col("n"), F.col("n"))).withColumn("size", size_class(F.col("n")))
    most = F.least(F.col("n") + 0.0, ((total + left) * (F.col("n") - F.col("at")) - total * F.col("n")) / total)  # of the smaller set's size
    lo, hi = size_class(F.ceil(F.col("n") * total / left - 1e-9)), size_class(F.floor(most + 1e-9))
    large = rows.withColumn("lo", lo).withColumn("hi", hi).where("lo <= hi").withColumn("size", F.explode(F.sequence("lo", "hi")))
    found = []
    for x, y in ((small, large.where("out")), (large.where("NOT out"), small.where("out"))):
        parts = x.groupBy("t", "size").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
        x = x.join(parts, ["t", "size"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        y = y.join(parts, ["t", "size"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        x, y = (z.select("t", "size", "part", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "root", "at")]) for z, s in ((x, "x"), (y, "y")))
        least = common_least(F.col("n_x"), F.col("n_y"))
        fits = (F.col("root_x") != F.col("root_y")) & (F.col("n_x") - F.col("at_x") >= least) & (F.col("n_y") - F.col("at_y") >= least)
        found.append(x.join(y, ["t", "size", "part"]).where(fits).select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")))
    return found[0].unionByName(found[1]).distinct()


def rows_of_components(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash long, n long, root long, component_id: one row for each row of documents. root tells components apart, also
    those of one name; it is null for an empty set."""
    spark = documents.sparkSession
    with working_tables(spark) as keep:
        sketches = keep(sketch(documents, shingle), "sketches")
        nodes = sketches.where("n > 0").groupBy("f1", "f2").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "n", "keys")).alias("r"))
        nodes = keep(nodes.select(F.col("f1").alias("node"), "f2", "r.doc_id", "r.text_hash", "r.n", "r.keys"), "nodes")
        members = keep(bucket_members(nodes), "members")
        stars = keep(star_edges(members), "candidates")
        links = keep(confirm(stars, documents, nodes, shingle), "links")
        components = connected_components(links, keep)
        left = keep(open_nodes(members, components), "open")
        sets = keep(sets_of(left.select("node"), documents, nodes, shingle).join(left.select("node", "root"), "node"), "open-sets")
        pairs = keep(open_pairs(keep(prefixes(sets), "prefixes")), "candidates")
        if not pairs.isEmpty():
            fresh = keep(confirm(pairs, documents, nodes, shingle), "links")
            if not fresh.isEmpty():
                components = connected_components(links.unionByName(fresh), keep)
        rooted = nodes.select("node", "f2", "doc_id").join(components, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        names = rooted.join(least, "root").select(F.col("node").alias("f1"), "f2", "root", "component_id")
        out = sketches.select("doc_id", "text_hash", "n", "f1", "f2").join(names, ["f1", "f2"], "left")
        out = out.select("doc_id", "text_hash", "n", "root", "component_id")
        path = write_table(out, "near-duplicates")
    return spark.read.schema(out.schema).parquet(path)


def cluster(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles long, component_id, kept boolean: one row for each row of documents."""
    out = rows_of_components(documents, shingle)
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_a_component(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash long, count long: the row of each component that stays, that of the least id (a null one comes last), and how
    many rows are the same. An empty set is a component with its copies only."""
    alone = F.when(F.col("n") == 0, F.struct("doc_id", "text_hash")).alias("alone")
    same = rows_of_components(documents, shingle).groupBy("root", alone, "doc_id", "text_hash").count()
    least = same.groupBy("root", "alone").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "count")).alias("r"))
    return least.select("r.doc_id", "r.text_hash", "r.count")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""

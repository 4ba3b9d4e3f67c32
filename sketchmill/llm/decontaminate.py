"""Benchmark decontamination with suffix arrays of the training text.

Training documents are cut into shards (runs of whole documents of an Arrow batch). In each shard, words become ids of the
benchmark's vocabulary (0: not in it), and a suffix array is sorted over the word positions from which a match of the required
length can start at all: with 0 ending every match, a suffix whose known words run out before that can't hold one. Every
benchmark suffix is binary-searched in the array of every shard, which gives its longest verbatim match. Where that is as long as a
window, the suffixes around it that share the window are all its places; hits, items and removal follow from these.

Words are found by 64-bit hashes and then compared byte by byte wherever they would count as hit, so results are exact.

The benchmark is worked off in blocks of about `block_words` words at most (by an upper bound of each item's words); each block is one
more pass over the documents, without any shuffle, and of several blocks one is held at a time.

Words: `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. A window is `window` consecutive item words; an item of
fewer, but not none, is one window.

Defined results: null or empty texts have no words, no hits and are not contaminated; null item texts have no windows; repeated
document rows are judged one by one; an item_id that occurs twice counts once in a document; null item_ids are skipped; an empty
benchmark contaminates nothing; an empty document table gives no rows; extra columns are kept by `remove_contaminated`.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_WORD, LOWER, extended, materialize, slices, spans, string_buffers, table, word_hashes

WINDOW = 13
#: Words of the benchmark that one pass holds in memory.
BLOCK_WORDS = 1_000_000
#: Suffix starts of one shard's array.
SHARD_SUFFIXES = 200_000
SLICE = 2_000_000


@dataclass
class Queries:
    """A block of the benchmark, as every task holds it."""

    vocabulary: np.ndarray  # sorted hashes; the id is the place + 1
    words: list[bytes]  # by id - 1
    bitmap: np.ndarray
    ids: np.ndarray  # all items' words, a 0 after each item, zeros at the end
    low: np.ndarray  # distinct windows as keys of WIDTH words, 0 after a short item's
    high: np.ndarray  # the same, with the highest ids there
    lengths: np.ndarray  # words in each window
    items: list[list[str]]  # item_ids with that window
    least: np.ndarray  # by id: words that a match beginning with it needs at least
    starts: np.ndarray  # places in ids of all suffixes that hold a window
    rest: np.ndarray  # words of them
    window_of: np.ndarray  # the window that each begins with
    suffix_item: list  # (item_id, word position) of them
    lead: np.ndarray  # a hash of the first words of them
    width: int  # words of a key
    longest: int  # words of the longest item


def lower_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    low = LOWER[data].tobytes()
    return [low[a:b] for a, b in zip(start.tolist(), end.tolist())]


def build_queries(items: list[tuple], window: int) -> Queries:
    import pyarrow as pa

    items = [(str(i), t) for i, t in items if i is not None and t]
    data, offsets = string_buffers(pa.array([t for _, t in items], pa.large_string()))
    start, end, first = spans(data, offsets, ALNUM_WORD)
    hashes, words = word_hashes(data, start, end), lower_words(data, start, end)
    vocabulary, at, back = np.unique(hashes, return_index=True, return_inverse=True)
    distinct = [words[k] for k in at]
    ids, starts, rest, named, window_of = [], [], [], [], []
    windows: dict[bytes, int] = {}
    holders: list[set[str]] = []
    place = longest = 0
    for r, (item, _) in enumerate(items):
        own = (back[first[r] : first[r + 1]] + 1).astype(np.int32)
        n = len(own)
        if not n:
            continue
        ids += [own, np.zeros(1, np.int32)]
        longest = max(longest, n)
        for k in range(max(1, n - window + 1)):
            w = windows.setdefault(own[k : k + window].tobytes(), len(windows))
            if w == len(holders):
                holders.append(set())
            holders[w].add(item)
            starts.append(place + k)
            rest.append(n - k)
            window_of.append(w)
            named.append((item, k))
        place += n + 1
    width = max(16, window)
    ids = np.concatenate([*ids, np.zeros(width + 64, np.int32)])
    low = np.zeros((len(windows), width), ">i4")
    for w, raw in enumerate(windows):
        part = np.frombuffer(raw, np.int32)
        low[w, : len(part)] = part
    lengths = (low > 0).sum(1)
    high = np.where(np.arange(width)[None, :] < lengths[:, None], low, 0x7FFFFFFF).astype(">i4")
    least = np.full(len(vocabulary) + 1, window, np.int64)
    np.minimum.at(least, low[:, 0].astype(np.int64), lengths)
    bitmap = np.zeros(1 << 22, bool)
    bitmap[vocabulary & np.uint64((1 << 22) - 1)] = True
    starts = np.array(starts, np.int64)
    as_keys = lambda x: np.ascontiguousarray(x).view(f"S{4 * width}").ravel()
    return Queries(vocabulary, distinct, bitmap, ids, as_keys(low), as_keys(high), lengths, [sorted(s) for s in holders], least, starts, np.array(rest, np.int64), np.array(window_of, np.int64), named, leads(ids, starts, least), width, longest)


#: Buckets of the hash of a suffix's first words.
LEADS = 1 << 20


def leads(ids: np.ndarray, at: np.ndarray, least: np.ndarray) -> np.ndarray:
    """A hash of the first word of suffixes and, where no window of one word begins with it, the second."""
    one = ids[at].astype(np.int64)
    two = np.where(least[one] > 1, ids[np.minimum(at + 1, len(ids) - 1)], 0).astype(np.int64) if len(ids) else one
    return (one * 0x9E3779B1 + two * 0x85EBCA6B) % LEADS


def word_ids(q: Queries, hashes: np.ndarray) -> np.ndarray:
    ids = np.zeros(len(hashes), np.int32)
    maybe = np.flatnonzero(q.bitmap[hashes & np.uint64(len(q.bitmap) - 1)])
    if len(maybe) and len(q.vocabulary):
        at = np.minimum(np.searchsorted(q.vocabulary, hashes[maybe]), len(q.vocabulary) - 1)
        same = q.vocabulary[at] == hashes[maybe]
        ids[maybe[same]] = at[same] + 1
    return ids


def runs(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word, how many words from it on are known, within its document."""
    n = len(ids)
    stop = np.full(n + 1, n, np.int64)
    unknown = np.flatnonzero(ids == 0)
    stop[unknown] = unknown
    nxt = np.minimum.accumulate(stop[::-1])[::-1][:n]
    row_end = np.repeat(first[1:], np.diff(first))
    return np.maximum(np.minimum(nxt, row_end) - np.arange(n), 0)


def key_rows(ids: np.ndarray, at: np.ndarray, run: np.ndarray, shift: int, width: int) -> np.ndarray:
    """Words shift.. of the suffixes as big-endian fixed-width keys that compare as byte strings; 0 past the run."""
    out = np.zeros((len(at), width), ">i4")
    for k in range(width):
        ok = run > shift + k
        out[ok, k] = ids[at[ok] + shift + k]
    return out.view(f"S{4 * width}").ravel()


def suffix_array(ids: np.ndarray, at: np.ndarray, run: np.ndarray, depth: int, width: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes by their first `depth` words (refined block by block where they tie), and the sorted first keys."""
    keys = key_rows(ids, at, run, 0, width)
    order = np.argsort(keys, kind="stable")
    first = keys[order]
    rank = np.cumsum(np.append(0, first[1:] != first[:-1])) if len(order) else np.zeros(0, np.int64)
    shift = width
    while shift < depth:
        tied = np.zeros(len(order), bool)
        same = rank[1:] == rank[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        tied &= run[order] >= shift
        place = np.flatnonzero(tied)
        if not len(place):
            break
        sub = order[place]
        block = np.unique(key_rows(ids, at[sub], run[sub], shift, width), return_inverse=True)[1]
        again = np.lexsort((block, rank[place]))
        order[place] = sub[again]
        pair = np.zeros(len(order), np.int64)
        pair[place] = block[again] + 1
        rank = np.cumsum(np.append(0, (rank[1:] != rank[:-1]) | (pair[1:] != pair[:-1])))
        shift += width
    return order, first


def match_length(q_ids: np.ndarray, q_at: np.ndarray, ids: np.ndarray, at: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Words that the suffixes q_at of the benchmark and at of the shard have in common."""
    n = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    while len(live):
        k = n[live]
        live = live[run[live] > k]
        k = n[live]
        live = live[ids[at[live] + k] == q_ids[q_at[live] + k]]
        n[live] += 1
    return n


def longest_in(q: Queries, s: np.ndarray, ids: np.ndarray, at: np.ndarray, run: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length and place of the longest match of each suffix s of the benchmark with the sorted suffixes at of a shard."""
    mine = key_rows(q.ids, q.starts[s], q.rest[s], 0, q.width)
    lo, hi = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
    live = np.flatnonzero(lo < hi)
    while len(live):  # equal first keys: binary search goes on with whole suffixes
        mid = (lo[live] + hi[live]) // 2
        own = q.starts[s[live]]
        n = match_length(q.ids, own, ids, at[mid], run[mid])
        there = np.where(n < run[mid], ids[np.minimum(at[mid] + n, len(ids) - 1)], 0)
        less = there < q.ids[own + n]
        lo[live[less]], hi[live[~less]] = mid[less] + 1, mid[~less]
        live = live[lo[live] < hi[live]]
    length, place = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
    for side in (lo - 1, lo):  # the longest match is next to where a suffix would stand
        ok = np.flatnonzero((side >= 0) & (side < len(at)))
        n = match_length(q.ids, q.starts[s[ok]], ids, at[side[ok]], run[side[ok]])
        better = n > length[ok]
        length[ok[better]], place[ok[better]] = n[better], at[side[ok[better]]]
    return length, place


def search_shard(q: Queries, data, start, end, ids, first):
    """Hit word mask; by window that occurs, the rows of its places; and of each benchmark suffix that matches a window's length at
    least: its number, the length of its longest match and the place of that."""
    run = runs(ids, first)
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    hit, sure = np.zeros(len(ids), bool), np.zeros(len(ids) + 1, np.int64)
    found: list[tuple[int, np.ndarray]] = []
    length, place = np.zeros(len(q.starts), np.int64), np.zeros(len(q.starts), np.int64)
    starts = np.flatnonzero((run >= q.least[ids]) & (ids > 0))
    for lo in range(0, len(starts), SHARD_SUFFIXES):
        at = starts[lo : lo + SHARD_SUFFIXES]
        order, keys = suffix_array(ids, at, run[at], q.longest, q.width)
        at = at[order]
        begins = np.zeros(LEADS, bool)
        begins[leads(ids, at, q.least)] = True
        some = np.flatnonzero(begins[q.lead])  # no other suffix shares its first words with the shard
        n, p = longest_in(q, some, ids, at, run[at], keys)
        better = n > length[some]
        length[some[better]], place[some[better]] = n[better], p[better]
        # the places of a window that occurs lie between its own key and its key filled up with the highest ids
        for w in np.unique(q.window_of[some[n >= q.lengths[q.window_of[some]]]]).tolist():
            a, b = np.searchsorted(keys, q.low[w], "left"), np.searchsorted(keys, q.high[w], "right")
            found.append((w, at[a:b]))
    for w, places in found:
        for k in range(q.lengths[w]):
            hit[places + k] = True
    best = np.flatnonzero(length >= q.lengths[q.window_of]) if len(length) else np.zeros(0, np.int64)
    np.add.at(sure, place[best], 1)
    np.add.at(sure, place[best] + length[best], -1)
    # hashes proposed; bytes decide
    low = LOWER[data].tobytes()
    wrong = [p for p in np.flatnonzero(hit | (np.cumsum(sure)[:-1] > 0)).tolist() if low[start[p] : end[p]] != q.words[ids[p] - 1]]
    if wrong:
        ids = ids.copy()
        ids[wrong] = 0
        return search_shard(q, data, start, end, ids, first)
    return hit, [(w, np.unique(rows[p])) for w, p in found], (best, length[best], place[best])


def _blocks(benchmark: DataFrame, block_words: int):
    """The items, in blocks of about so many words at most: a text of n characters has (n + 1) / 2 words at most."""
    rows = benchmark.select(F.col("item_id"), F.col("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    words = rows.agg(F.coalesce(F.sum((F.length("text") + 1) / 2), F.lit(0)).cast("long").alias("n")).first()["n"]
    parts = -(-words // block_words) or 1
    for k in range(parts):
        part = rows.where(F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(parts)) == k)
        yield [tuple(r) for r in part.collect()]


def find_hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The columns of documents, and n_words long, spans array<struct<start,stop>> of hit words, items array<string>."""
    carried = [c for c in documents.columns if c not in ("n_words", "spans", "items")]
    out = documents.select(*carried)
    schema = extended(out, "n_words long, spans array<struct<start:long,stop:long>>, items array<string>")
    names, text_at = schema.fieldNames(), carried.index("text")
    spark = documents.sparkSession
    fresh, before = True, None
    for items in _blocks(benchmark, block_words):
        if before is not None:  # of several blocks, each pass is written before the next block is held
            out = materialize(out, "hits")
            before.unpersist()
        before = shared = spark.sparkContext.broadcast(build_queries(items, window))

        def search(batches, shared=shared, fresh=fresh):
            import pyarrow as pa

            q = shared.value
            for batch in batches:
                data, offsets = string_buffers(batch.column(text_at))
                counts, found, named = [], [[] for _ in range(len(offsets) - 1)], [set() for _ in range(len(offsets) - 1)]
                for i, j, part, off in slices(data, offsets, SLICE):
                    start, end, first = spans(part, off, ALNUM_WORD)
                    counts += np.diff(first).tolist()
                    if not len(start) or not len(q.starts):
                        continue
                    hit, rows, _ = search_shard(q, part, start, end, word_ids(q, word_hashes(part, start, end)), first)
                    edge = np.diff(np.concatenate(([0], hit, [0])).astype(np.int8))
                    cut = np.zeros(len(hit) + 1, bool)
                    cut[first[1:-1]] = True
                    begins = np.flatnonzero((edge == 1) | (cut & np.append(hit, False) & np.append(False, hit)))
                    ends = np.flatnonzero((edge == -1) | (cut & np.append(hit, False) & np.append(False, hit)))
                    row = np.searchsorted(first, begins, "right") - 1
                    for r, a, b in zip(row.tolist(), begins.tolist(), ends.tolist()):
                        found[i + r].append((a - int(first[r]), b - int(first[r])))
                    for w, docs in rows:
                        for r in docs.tolist():
                            named[i + r].update(q.items[w])
                if not fresh:
                    for r, (spans_, items_) in enumerate(zip(batch.column(len(carried) + 1).to_pylist(), batch.column(len(carried) + 2).to_pylist())):
                        found[r] = _merge(found[r] + [(x["start"], x["stop"]) for x in spans_])
                        named[r].update(items_)
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.columns[: len(carried)],
                        pa.array(counts, pa.int64()),
                        pa.array([[{"start": a, "stop": b} for a, b in x] for x in found], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                        pa.array([sorted(x) for x in named], pa.list_(pa.string())),
                    ],
                    names,
                )

        out = out.mapInArrow(search, schema)
        fresh = False
    return out


def _merge(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def judge(hits: DataFrame) -> DataFrame:
    """Adds n_hit, n_items and contaminated (at least a twentieth of the words is hit) to find_hits' rows."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return hits.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    return judge(find_hits(documents, benchmark, window)).where(~F.col("contaminated")).select(*documents.columns)


def longest_matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every benchmark suffix that matches at least a window's length (a shorter item: its whole): item_id string, item_word long, longest long, and one place
    of that match: doc_id, doc_word long (the smallest). Shards send their best; the best of all shards is kept."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    best = None
    for items in _blocks(benchmark, BLOCK_WORDS):
        shared = documents.sparkSession.sparkContext.broadcast(build_queries(items, window))

        def search(batches, shared=shared):
            import pyarrow as pa

            q = shared.value
            for batch in batches:
                data, offsets = string_buffers(batch.column(1))
                for i, _, part, off in slices(data, offsets, SLICE):
                    start, end, first = spans(part, off, ALNUM_WORD)
                    if not len(start) or not len(q.starts):
                        continue
                    suffix, length, place = search_shard(q, part, start, end, word_ids(q, word_hashes(part, start, end)), first)[2]
                    row = np.searchsorted(first, place, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([q.suffix_item[k][0] for k in suffix], pa.string()),
                            pa.array([q.suffix_item[k][1] for k in suffix], pa.int64()),
                            pa.array(length, pa.int64()),
                            batch.column(0).take(pa.array(i + row, pa.int64())),
                            pa.array(place - first[row], pa.int64()),
                        ],
                        ["item_id", "item_word", "longest", "doc_id", "doc_word"],
                    )

        got = documents.select("doc_id", "text").mapInArrow(search, f"item_id string, item_word long, longest long, doc_id {kind}, doc_word long")
        best = got if best is None else best.unionByName(got)
    top = best.groupBy("item_id", "item_word").agg(F.min(F.struct((-F.col("longest")).alias("longest"), "doc_id", "doc_word")).alias("b"))
    return top.select("item_id", "item_word", (-F.col("b.longest")).alias("longest"), "b.doc_id", "b.doc_word")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge(find_hits(documents, table(spark, sf_dir, "benchmark")))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: The SHA-256 of no items at all.
NO_ITEMS = hashlib.sha256(b"").hexdigest()


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
      FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM q),
occ AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g
        FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, sizes WHERE len(w) >= k)),
m AS (SELECT DISTINCT o.doc_id, o.i, o.k, q.item_id FROM occ o JOIN q USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM m) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""

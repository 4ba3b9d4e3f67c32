"""Hierarchical Pitman-Yor language model (order 2) with Chinese-restaurant seating sampled by distributed Gibbs sweeps.

Restaurants: one for each preceding token (a document's start is one of them), all sharing one parent for single tokens, whose base
is uniform over the V training tokens and one unknown token. A customer who opens a table in a context's restaurant becomes a
customer of the parent.

How it is spread out. The corpus is cut into blocks (runs of whole documents, about BLOCK_BYTES of text). A block holds its token
ids and its own vocabulary as 64-bit hashes; this table is written once. Blocks ask and answer through buckets of the hash range:
a block sends each bucket one row with what it knows of the words (or word pairs) there, the bucket adds up and answers each block
in the block's own order. So rows are few and large, a frequent word is one entry a block, and no part of the model is ever
gathered in one place. Whole numbers travel compressed.

- counts: training count of every word.
- pairs: training count of every word pair, told to one block that holds it: the pair's owner. A block's owned pairs are written as a
  table of their own, which is all that the sweeps read.
- seatings: owners draw the tables of a pair from the seating rule given the last sweep's totals, by uniforms that are a hash of
  (pair, customer, sweep, chain), and send them by context and by word; a word's bucket adds them up and seats the parent. All chains
  start from one table a pair and make SWEEPS sweeps side by side. So a pair is seated once a sweep and chain, however many blocks
  hold it.
- tables: owners send what they drew through the pairs' buckets to all blocks that hold a pair.
- scores: log10 of the predictive probability averaged over all chains and sweeps, summed over a document.

A sweep reseats the customers of every dish in every restaurant given what all others had after the last sweep (their tables and the
parent's predictive probabilities). It is a blocked and synchronous form of Gibbs sampling: a dish's customers leave together and come
back one after the other by the seating rule, and all dishes do so at once; they are not removed and reseated one at a time between
the others' moves. Each draw follows the rule exactly: customer by customer up to SINGLY of a pair, beyond by skips to the next new
table, so a pair costs steps in proportion to its tables and the logarithm of its customers.
Discounts are estimated from the counts of ones and twos of all data; STRENGTH is fixed.

Defined results: null or empty text is the end token alone; null doc_ids are learned from; repeated rows count as often as they
occur; without training documents every score is 0 (one unknown token has all the mass); an empty table gives no rows; extra columns
are ignored. Whole texts count.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED_WORD, crc_mod, drop_table, mix, release, slices, spans, string_buffers, table, word_hashes, write_table

BLOCK_BYTES = 8_000_000
BUCKET_ENTRIES = 400_000
CHAINS, SWEEPS = 2, 2
#: Passes in which pairs' tables are sent, each over a share of the buckets, so that less is in flight at once.
PASSES = 4
STRENGTH = 1.0
#: Customers of a pair that are seated one by one; beyond, the draw skips to the next new table.
SINGLY = 16
END, BEGIN = np.uint64(0x0E0D_0E0D_0E0D_0E0D), np.uint64(0xBE61_BE61_BE61_BE61)
FOLDS, HELD_OUT = 7, 2


# ---------------------------------------------------------------- seating


def uniforms(keys: np.ndarray, draw: int, sweep: int) -> np.ndarray:
    return (mix(keys + np.uint64((draw * 0x9E3779B97F4A7C15 + sweep * 0xD1B54A32D192ED03) % (1 << 64))) >> np.uint64(11)) * 2.0**-53


def seat(keys: np.ndarray, customers: np.ndarray, new_weight: np.ndarray, discount: float, sweep: int) -> np.ndarray:
    """Tables of each dish: the first customer opens one; with k seated at t tables, the next opens one with probability
    new_weight / (new_weight + k - discount * t)."""
    tables = (customers > 0).astype(np.int64)
    live = np.flatnonzero(customers > 1)
    live = live[np.argsort(-np.minimum(customers[live], SINGLY + 1).astype(np.int8), kind="stable")]  # those of a further customer lead
    key, a, last = keys[live], new_weight[live], customers[live]
    t = np.ones(len(live))
    more = len(live) - np.cumsum(np.bincount(np.minimum(last, SINGLY + 1), minlength=SINGLY + 2))
    for k in range(1, SINGLY):
        m = more[k]
        t[:m] += uniforms(key[:m], k, sweep) * (a[:m] + k - discount * t[:m]) < a[:m]
    tables[live] = t
    m = more[SINGLY]
    live, key, a, last, t = live[:m], key[:m], a[:m], last[:m], t[:m]
    k, draw = np.full(m, float(SINGLY)), SINGLY
    while len(live):
        # with no new table the chance only falls, so the next one is no sooner than at today's chance; there the draw is thinned
        s = k - discount * t
        skip = np.floor(np.log1p(-uniforms(key, draw, sweep)) / -np.log1p(a / s))
        on = k + skip < last
        opens = on & (uniforms(key, draw + 1, sweep) * (a + s + skip) < a + s)
        t += opens
        k += skip + 1
        draw += 2
        done = k >= last
        if done.any():
            tables[live[done]] = t[done]
            stay = ~done
            live, key, a, last, t, k = live[stay], key[stay], a[stay], last[stay], t[stay], k[stay]
    return tables


def discount_of(ones: float, twos: float) -> float:
    """Share that the counts of ones and twos suggest, kept off the ends."""
    return float(min(0.95, max(0.05, ones / (ones + 2 * twos) if ones + twos else 0.5)))


# ---------------------------------------------------------------- blocks


def pack(*arrays: np.ndarray) -> bytes:
    """int32 arrays of one length, by byte planes, compressed."""
    import zstandard

    x = np.concatenate([a.astype("<i4") for a in arrays])
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(blob: bytes, arrays: int = 1) -> np.ndarray:
    """[arrays, length]"""
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8) if blob else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").reshape(arrays, -1)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as byte planes of their steps: the high planes are nearly all 0."""
    import zstandard

    steps = np.diff(keys, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_keys(blob: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def make_blocks(documents: DataFrame) -> DataFrame:
    """documents: doc_id, text, learn boolean. Local ids go by falling frequency, so they compress well."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        import pandas as pd
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = string_buffers(batch.column(1))
            learn = np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
            for i, j, part, off in slices(data, offsets, BLOCK_BYTES):
                start, end, first = spans(part, off, SPACED_WORD)
                tokens = np.insert(word_hashes(part, start, end), first[1:], END)
                sizes = np.diff(first) + 1
                ids, vocabulary = pd.factorize(np.append(tokens, BEGIN))
                order = np.argsort(-np.bincount(ids), kind="stable")
                rank = np.empty(len(order), np.int32)
                rank[order] = np.arange(len(order))
                vocabulary, ids = vocabulary[order], rank[ids]
                ids, begin = ids[:-1], int(ids[-1])
                known = np.bincount(ids[np.repeat(learn[i:j], sizes)], minlength=len(vocabulary))
                known[begin] = learn[i:j].sum()
                docs = batch.column(0)[i:j]
                blobs = [pack(learn[i:j], sizes), pack(ids), vocabulary.tobytes(), pack(known)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs), *[pa.array([b], pa.binary()) for b in blobs], pa.array([len(vocabulary)], pa.int64()), pa.array([len(tokens)], pa.int64())],
                    ["block", "docs", "cuts", "ids", "vocabulary", "known", "n_words", "n_tokens"],
                )
                number += 1

    return documents.select("doc_id", "text", "learn").mapInArrow(cut, f"block long, docs array<{kind}>, cuts binary, ids binary, vocabulary binary, known binary, n_words long, n_tokens long")


def within(hashes: np.ndarray, buckets: int, part: tuple[int, int]) -> np.ndarray:
    """Places of the hashes in a share of the buckets: the k-th of n runs of whole buckets; part: (k, n)."""
    low, high = (k * buckets // part[1] for k in (part[0], part[0] + 1))
    if low == high:
        return np.zeros(0, np.int64)
    first, last = -(-(low << 64) // buckets), -(-(high << 64) // buckets) - 1
    return np.flatnonzero((hashes >= np.uint64(first)) & (hashes <= np.uint64(last)))


def parts_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bounds of the buckets in sorted hashes: a bucket is a range of hashes."""
    edges = np.array([-(-(b << 64) // buckets) for b in range(1, buckets)], object).astype(np.uint64) if buckets > 1 else np.zeros(0, np.uint64)
    return np.concatenate(([0], np.searchsorted(hashes, edges), [len(hashes)]))


REQUEST = "bucket int, block long, keys binary, n binary"
ANSWER = "stage int, bucket int, block long, n binary, sums array<double>"


def request_rows(block: int, keys: np.ndarray, arrays: list[np.ndarray], buckets: int):
    """keys: sorted; arrays: of the same length (none: the block only asks)."""
    import pyarrow as pa

    cut = parts_of(keys, buckets)
    some = np.flatnonzero(np.diff(cut))
    held = [pack_keys(keys[cut[k] : cut[k + 1]]) for k in some]
    told = [pack(*[a[cut[k] : cut[k + 1]] for a in arrays]) if arrays else b"" for k in some]
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([block] * len(some), pa.int64()), pa.array(held, pa.binary()), pa.array(told, pa.binary())], ["bucket", "block", "keys", "n"])


def answers(requests: DataFrame, stage: int, arrays: int, combine) -> DataFrame:
    """combine(place of each entry's key, distinct keys, [arrays, entries]) -> arrays by entry, sums. Rows of a block under 0 only tell."""

    def reply(frame):
        import pandas as pd

        frame = frame.sort_values("block")
        keys = [unpack_keys(x) for x in frame["keys"]]
        told = np.concatenate([unpack(x, arrays) if x else np.zeros((arrays, len(k)), np.int32) for x, k in zip(frame["n"], keys)], 1)
        place, distinct = pd.factorize(np.concatenate(keys))
        outs, sums = combine(place, distinct, told)
        ends = np.append(0, np.cumsum([len(x) for x in keys]))
        asks = np.flatnonzero(frame["block"].to_numpy() >= 0)
        blobs = [pack(*[o[ends[k] : ends[k + 1]] for o in outs]) for k in asks]
        sums = [[float(x) for x in sums]] + [None] * (len(asks) - 1)
        return pd.DataFrame({"stage": np.int32(stage), "bucket": frame["bucket"].to_numpy()[asks], "block": frame["block"].to_numpy()[asks], "n": blobs, "sums": sums[: len(asks)]})

    return requests.groupBy("bucket").applyInPandas(reply, ANSWER)


class Block:
    """A block's vocabulary with the answers that it has got."""

    def __init__(self, row: dict, constants: dict):
        self.constants = constants
        self.vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
        self.order = np.argsort(self.vocabulary)
        got: dict[int, list[np.ndarray]] = {}
        for x in sorted(row.get("answers") or (), key=lambda x: (x["stage"], x["bucket"])):
            got.setdefault(x["stage"], []).append(unpack(x["n"], constants["widths"][x["stage"]]))
        self.told = {stage: np.concatenate(parts, 1) for stage, parts in got.items()}

    def by_word(self, stage: int) -> np.ndarray:
        """An answer about the block's words, in the order of its local ids."""
        whole = self.told[stage]
        out = np.empty((len(whole), len(self.vocabulary)), np.int64)
        out[:, self.order] = whole
        return out

    def words(self, *arrays: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """A request about the block's words."""
        return self.vocabulary[self.order], [a[self.order] for a in arrays]

    def state(self, level: int, chain: int) -> np.ndarray:
        """Of each local word at the end of a level: tables in its restaurant, customers and tables of it in the parent."""
        return self.by_word(STATES + level).reshape(-1, 3, len(self.vocabulary))[chain if level else 0]

    def parent(self, level: int, chain: int, state: np.ndarray) -> np.ndarray:
        """The shared parent's predictive probability of each local word."""
        k, (_, customers, tables) = self.constants, state
        total, opened = k["totals"][level][chain if level else 0]
        d = k["parent_discount"]
        return (np.maximum(customers - d * tables, 0) + (STRENGTH + d * opened) / (k["V"] + 1)) / (STRENGTH + total)


def pair_hashes(vocabulary: np.ndarray, u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix((vocabulary * np.uint64(0xA0761D6478BD642F))[u] + (vocabulary * np.uint64(0xE7037ED1A0B428DB))[w])


def token_ids(row: dict, vocabulary: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a block: learn and size of each document, local id of each token and of the token before it."""
    learn, sizes = unpack(row["cuts"], 2)
    ids = unpack(row["ids"])[0]
    before = np.empty(len(ids), np.int64)
    before[1:] = ids[:-1]
    before[np.append(0, np.cumsum(sizes))[:-1]] = int(np.flatnonzero(vocabulary == BEGIN)[0])
    return learn.astype(bool), sizes, ids, before


def asked(row: dict, buckets: int, part: tuple[int, int]) -> np.ndarray:
    """Sorted hashes of a block's pairs in a share of the buckets: the others are left out before pairs are told apart and sorted."""
    import pandas as pd

    vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
    n, (*_, ids, before) = len(vocabulary), token_ids(row, vocabulary)
    some = within(pair_hashes(vocabulary, before, ids), buckets, part)
    code = pd.unique(before[some] * n + ids[some])
    return np.sort(pair_hashes(vocabulary, code // n, code % n))


class Tokens(Block):
    """A block with its token ids: its pairs u, w (local ids) in the order of their hashes, and the pair of each token."""

    def __init__(self, row: dict, constants: dict):
        import pandas as pd

        super().__init__(row, constants)
        self.learn, self.sizes, self.ids, before = token_ids(row, self.vocabulary)
        n = len(self.vocabulary)
        pair_of, code = pd.factorize(before * n + self.ids)
        u, w = code // n, code % n
        keys = pair_hashes(self.vocabulary, u, w)
        order = np.argsort(keys)
        self.keys, self.u, self.w = keys[order], u[order], w[order]
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        self.pair_of = place[pair_of]

    def train_pairs(self) -> np.ndarray:
        on = np.repeat(self.learn, self.sizes)
        return np.bincount(self.pair_of[on], minlength=len(self.u))

    def predictive(self, count: np.ndarray) -> np.ndarray:
        """P(word | context) of each distinct pair of the block, averaged over chains and sweeps; count: of the block's words."""
        d, in_context, told = self.constants["discount"], count[self.u], self.told[self.constants["tables"]]
        total, drawn = np.zeros(len(self.u)), told[1:]
        for k in range(len(drawn)):
            level, chain = 1 + k // CHAINS, k % CHAINS
            state = self.state(level, chain)
            below = self.parent(level, chain, state)[self.w]
            seated = np.maximum(told[0] - d * drawn[k], 0)
            p = (seated + (STRENGTH + d * state[0][self.u]) * below) / (STRENGTH + in_context)
            total += np.where(in_context > 0, p, below)
        return total / len(drawn)


class Owned(Block):
    """A block with the pairs that it owns, by context and word."""

    def __init__(self, row: dict, constants: dict):
        super().__init__(row, constants)
        # stored as steps: from context to context, and within a context from word to word
        u, w, self.pair_count = unpack(row["pairs"], 3).astype(np.int64)
        upto, first = np.cumsum(w), np.flatnonzero(u > 0)
        self.u = np.cumsum(u) - 1
        self.w = upto - np.repeat(upto[first] - w[first], np.diff(np.append(first, len(u))))
        self.keys = pair_hashes(self.vocabulary, self.u, self.w)

    def tables(self, level: int, chain: int, some: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Tables of each pair, or of some pairs."""
        if level == 0:
            return np.ones(len(self.u), np.int64)[some]
        d, state = self.constants["discount"], self.state(level - 1, chain)
        others = np.maximum(state[0] - 1, 0)[self.u[some]]  # the context's tables so far, less the pair's first
        return seat(self.keys[some], self.pair_count[some], (STRENGTH + d * others) * self.parent(level - 1, chain, state)[self.w[some]], d, level * CHAINS + chain)

    def sums(self, level: int) -> list[np.ndarray]:
        """Tables of the pairs, by context and by word, chain by chain."""
        out = []
        for chain in range(CHAINS if level else 1):
            t = self.tables(level, chain)
            out += [np.bincount(x, t, len(self.vocabulary)).astype(np.int32) for x in (self.u, self.w)]
        return out

    def drawn(self, seatings: int, buckets: int, part: tuple[int, int] = (0, 1)) -> tuple[np.ndarray, list[np.ndarray]]:
        """The hashes of a share's pairs in their order, and with it their counts and the tables of every level and chain."""
        some = within(self.keys, buckets, part)
        some = some[np.argsort(self.keys[some])]
        return self.keys[some], [self.pair_count[some], *[self.tables(1 + k // CHAINS, k % CHAINS, some) for k in range(seatings)]]


#: Stages of answers: words' counts, owned pairs' counts, then a state a level, then the pairs' tables.
WORDS, PAIRS, STATES = 0, 1, 2


def _count_words(place, keys, told):
    total = np.bincount(place, told[0], len(keys))
    token = keys != BEGIN
    return [total[place]], [(total[token] > 0).sum(), total[token].sum()]


def _count_pairs(place, keys, told):
    """The count goes to the first block with a training occurrence, the pair's owner; the others get 0."""
    total = np.bincount(place, told[0], len(keys))
    has = np.flatnonzero(told[0] > 0)
    first = np.full(len(keys), -1, np.int64)
    first[place[has[::-1]]] = has[::-1]
    own = np.zeros(len(place), np.int64)
    own[first[first >= 0]] = total[first >= 0]
    return [own], [(total == 1).sum(), (total == 2).sum()]


def _pass_on(place, keys, told):
    return [np.bincount(place, a, len(keys))[place] for a in told], [0.0]


def _seat_parent(level: int, n_words: float, discount: float | None):
    def combine(place, keys, told):
        outs, sums = [], []
        for chain in range(len(told) // 2):
            contexts, customers = (np.bincount(place, told[2 * chain + k], len(keys)).astype(np.int64) for k in (0, 1))
            tables = (customers > 0).astype(np.int64)
            if level:
                tables = seat(keys, customers, np.full(len(keys), (STRENGTH + discount * n_words) / (n_words + 1)), discount, level * CHAINS + chain)
            outs += [contexts[place], customers[place], tables[place]]
            sums += [customers.sum(), tables.sum(), (customers == 1).sum(), (customers == 2).sum()]
        return outs, sums

    return combine


def score(documents: DataFrame, sweeps: int = SWEEPS) -> DataFrame:
    """documents: doc_id, text, learn boolean -> doc_id, learn, n_tokens, n_known, train_tokens, base_score, score."""
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    blocks = spark.read.parquet(write_table(make_blocks(documents), "blocks", "none"))
    size = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("w"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t")).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    word_buckets, pair_buckets = max(least, -(-size["w"] // BUCKET_ENTRIES)), max(least, -(-size["t"] // BUCKET_ENTRIES))
    made = CHAINS * sweeps  # seatings of a pair that are averaged
    constants: dict = {"V": 0.0, "N": 0.0, "discount": 0.5, "parent_discount": 0.5, "totals": [], "widths": {WORDS: 1, PAIRS: 1}, "tables": STATES + sweeps + 1}
    paths: dict[int, list[str]] = {}

    def keep(requests: DataFrame, stage: int, arrays: int, combine) -> list[float]:
        release(spark)  # the exchange before this one is not needed any more
        paths.setdefault(stage, []).append(write_table(answers(requests, stage, arrays, combine), "answers", "none"))
        parts = spark.read.parquet(paths[stage][-1]).where("sums IS NOT NULL").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s"))
        return [r["s"] for r in sorted(parts.collect(), key=lambda r: r["pos"])] or [0.0] * (4 * CHAINS)

    def told(table_: DataFrame, stages: list[int], *columns: str) -> DataFrame:
        """A table's blocks with the answers of some stages: one shuffle of the blocks, one of the answers."""
        got = spark.read.parquet(*[path for k in stages for path in paths[k]]).groupBy("block").agg(F.collect_list(F.struct("stage", "bucket", "n")).alias("answers"))
        return table_.select("block", *columns).join(got, "block")

    def each(source: DataFrame, view, make, schema: str) -> DataFrame:
        """make(block number, view) -> a batch."""
        fixed = dict(constants)

        def run(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                    yield make(row["block"], view(row, fixed))

        return source.mapInArrow(run, schema)

    def send_words(batches):
        for batch in batches:
            for block, vocabulary, known in zip(*[c.to_pylist() for c in batch.columns]):
                keys = np.frombuffer(vocabulary, np.uint64)
                order = np.argsort(keys)
                yield request_rows(block, keys[order], [unpack(known)[0][order]], word_buckets)

    def own_pairs(block: int, view: Tokens):
        import pyarrow as pa

        count = view.told[PAIRS][0]
        mine = np.flatnonzero(count)
        mine = mine[np.lexsort((view.w[mine], view.u[mine]))]
        u, w = np.diff(view.u[mine], prepend=-1), view.w[mine]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([view.vocabulary.tobytes()], pa.binary()), pa.array([pack(u, np.where(u > 0, w, np.diff(w, prepend=0)), count[mine])], pa.binary())], ["block", "vocabulary", "pairs"])

    constants["V"], constants["N"] = keep(blocks.select("block", "vocabulary", "known").mapInArrow(send_words, REQUEST), WORDS, 1, _count_words)[:2]
    tokens = blocks.select("block", "cuts", "ids", "vocabulary")
    pairs = keep(each(tokens, Tokens, lambda block, view: request_rows(block, view.keys, [view.train_pairs()], pair_buckets), REQUEST), PAIRS, 1, _count_pairs)
    constants["discount"] = discount_of(*pairs[:2])
    release(spark)
    owned = each(told(blocks, [PAIRS], "cuts", "ids", "vocabulary"), Tokens, own_pairs, "block long, vocabulary binary, pairs binary")
    owned_path = write_table(owned, "owned", "none")
    owned = spark.read.parquet(owned_path)
    drop_table(spark, paths[PAIRS][0])
    for level in range(sweeps + 1):
        chains = CHAINS if level else 1
        source = told(owned, [STATES + level - 1], "vocabulary", "pairs") if level else owned
        ask = each(source, Owned, lambda block, view, level=level: request_rows(block, *view.words(*view.sums(level)), word_buckets), REQUEST)
        sums = keep(ask, STATES + level, 2 * chains, _seat_parent(level, constants["V"], constants["parent_discount"]))
        constants["widths"][STATES + level] = 3 * chains
        if level == 0:
            constants["parent_discount"] = discount_of(*sums[2:4])
        constants["totals"].append([(sums[4 * c], sums[4 * c + 1]) for c in range(chains)])
    drawn = list(range(STATES, STATES + sweeps))
    for k in range(PASSES):
        part = (k, PASSES)
        tell = each(told(owned, drawn, "vocabulary", "pairs"), Owned, lambda block, view, part=part: request_rows(-1 - block, *view.drawn(made, pair_buckets, part), pair_buckets), REQUEST)
        ask = each(tokens, lambda row, _, part=part: asked(row, pair_buckets, part), lambda block, keys: request_rows(block, keys, [], pair_buckets), REQUEST)
        keep(tell.unionByName(ask), constants["tables"], 1 + made, _pass_on)
    constants["widths"][constants["tables"]] = 1 + made
    drop_table(spark, paths[STATES][0])
    drop_table(spark, owned_path)
    release(spark)
    fixed = dict(constants)

    def finish(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                view = Tokens({c: batch.column(c)[k].as_py() for c in batch.schema.names if c != "docs"}, fixed)
                count = view.by_word(WORDS)[0]
                token = np.log10(view.predictive(count))[view.pair_of]
                base = np.log10((count + 1) / (fixed["N"] + fixed["V"] + 1))
                begins = np.append(0, np.cumsum(view.sizes))[:-1]
                add = lambda x: np.add.reduceat(x, begins)
                n = len(view.sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("docs").slice(k, 1).flatten(),
                        pa.array(view.learn),
                        pa.array(view.sizes.astype(np.int64)),
                        pa.array(add((count > 0)[view.ids].astype(np.int64))),
                        pa.array(np.full(n, int(fixed["N"]), np.int64)),
                        pa.array(add(base[view.ids])),
                        pa.array(add(token)),
                    ],
                    ["doc_id", "learn", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    last = told(blocks, [WORDS, *[STATES + level for level in range(1, sweeps + 1)], constants["tables"]], "docs", "cuts", "ids", "vocabulary")
    return last.mapInArrow(finish, f"doc_id {kind}, learn boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def perplexity(scores: DataFrame) -> DataFrame:
    """held_out, n_tokens, perplexity of the model and of the base."""
    of = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), of("score").alias("perplexity"), of("base_score").alias("base_perplexity"))


def op6_pitman_yor_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_mod("doc_id", FOLDS) != HELD_OUT).alias("learn"))
    return score(documents).select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

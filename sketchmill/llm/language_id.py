"""Language identification by prediction by partial matching (PPM, escape method C with exclusion) over bytes.

Each language has a context tree of orders 0 to ORDER; its statistics are frozen after training, so the code length of a byte
after any context is a constant. These constants are tabled once on the driver (contexts x symbols x languages), and a text's
code length under each language is the sum of looked-up constants: exact, one pass, no shuffle.

Training takes a sample of the labelled rows: about `sample_docs` documents a language, chosen by a hash of the id. Counting runs
on the executors; only the different (ORDER+1)-grams of the sample reach the driver. Languages are worked off LANGS_AT_ONCE at a
time, in the order of their names, so one table holds the statistics of a bounded number of bounded samples; each further group is
one more pass over the texts, which carries the best code length so far.

Defined results: null text, or text without a letter: lang_pred `und`, score 0. Rows with a null lang are scored but not learned
from. Ties go to the smaller language name. With nothing to learn from, every row is `und`. An empty table gives no rows.
Repeated rows are scored alike. Extra columns are ignored. Whole texts count.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, crc_mod, extended, materialize, slices, string_buffers, table

ORDER = 3
#: Documents a language that the models are learned from (about: rows are chosen by a hash, independently).
SAMPLE_DOCS = 400
#: Languages of one table.
LANGS_AT_ONCE = 16
UNKNOWN = "und"


# ---------------------------------------------------------------- training


def gram_codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Every byte with its up to ORDER predecessors of the same text, as 8-bit fields: 0 where there is none, else byte + 1 in 9 bits."""
    n = len(data)
    code = np.zeros(n, np.int64)
    position = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
    low = LOWER[data].astype(np.int64) + 1
    for k in range(ORDER + 1):
        shifted = np.zeros(n, np.int64)
        shifted[k:] = low[: n - k] if k else low
        shifted[position < k] = 0
        code |= shifted << (9 * k)
    return code


def count_grams(rows: DataFrame) -> DataFrame:
    """rows: lang, text -> lang, gram long, n long, summed within each batch already."""

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            langs = batch.column(0).to_pylist()
            data, offsets = string_buffers(batch.column(1))
            for lang in sorted(set(langs)):
                for i, j, part, off in slices(data, offsets):
                    own = np.repeat([x == lang for x in langs[i:j]], np.diff(off)).astype(bool) if j > i else np.zeros(0, bool)
                    grams, n = np.unique(gram_codes(part, off)[own], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])

    return rows.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class FrozenTrees:
    """Tables that give, for a context and a next symbol, the code length in bits under each language."""

    def __init__(self, langs: list[str], lang_of: np.ndarray, grams: np.ndarray, counts: np.ndarray):
        self.langs = langs
        fields = np.stack([(grams >> (9 * k)) & 511 for k in range(ORDER + 1)], 1)  # column 0: the symbol; k: its k-th predecessor
        seen = np.unique(fields[:, 0])
        self.n_symbols = len(seen) + 1  # the last stands for every byte not seen
        self.symbol = np.full(513, self.n_symbols - 1, np.int64)
        self.symbol[seen] = np.arange(len(seen))
        size, others = self.n_symbols, 256 - len(seen)
        sym = self.symbol[fields]
        base = np.full(size, 1 / 256)
        base[-1] = others / 256
        # contexts by order; known[k] maps (id at order k-1 of the older symbols) * size + newest symbol -> id at order k
        ids = np.zeros(len(grams), np.int64)
        valid = np.ones(len(grams), bool)
        self.lookup, suffix, rows = [], [np.zeros(1, np.int64)], [ids]
        paths = {0: np.zeros((1, 0), np.int64)}
        for k in range(1, ORDER + 1):
            valid = valid & (fields[:, k] > 0)
            path = sym[:, k:0:-1]  # oldest first
            code = np.zeros(len(grams), np.int64)
            for c in range(k):
                code = code * size + path[:, c]
            known = np.unique(code[valid])
            ids = np.where(valid, np.searchsorted(known, code), -1)
            rows.append(ids)
            tail = known % (size ** (k - 1))
            suffix.append(np.zeros(len(known), np.int64) if k == 1 else np.searchsorted(paths[k - 1], tail))
            paths[k] = known
            # from the id of the first k-1 symbols
            if k == 1:
                step = np.full(size, -1, np.int32)
                step[known] = np.arange(len(known))
            else:
                head = np.searchsorted(paths[k - 1], known // size)
                head_known = (head < len(paths[k - 1])) & (paths[k - 1][np.minimum(head, len(paths[k - 1]) - 1)] == known // size)
                step = np.full(len(paths[k - 1]) * size, -1, np.int32)
                step[(head * size + known % size)[head_known]] = np.flatnonzero(head_known)
            self.lookup.append(step)
        self.first = np.cumsum([0, 1] + [len(paths[k]) for k in range(1, ORDER)])  # where each order's contexts begin
        total = 1 + sum(len(paths[k]) for k in range(1, ORDER + 1))
        self.bits = np.empty((total * size, len(langs)), np.float32)
        for j in range(len(langs)):
            below = base[None, :]
            for k in range(ORDER + 1):
                n_ctx = 1 if k == 0 else len(paths[k])
                own = (lang_of == j) & (rows[k] >= 0)
                c = np.bincount(rows[k][own] * size + sym[own, 0], counts[own], n_ctx * size).reshape(n_ctx, size)
                lower = below[suffix[k]] if k else below
                at, distinct = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
                open_mass = np.where(c > 0, 0, lower)
                room = open_mass.sum(1, keepdims=True)
                with np.errstate(divide="ignore", invalid="ignore"):
                    p = np.where(c > 0, c, distinct * open_mass / room) / (at + distinct)
                full = (room <= 1e-12) & (at > 0)
                p = np.where(full, np.where(c > 0, c, 0) / np.maximum(at, 1), p)
                p = np.where(at > 0, np.maximum(p, 1e-12), lower)
                cost = -np.log2(p)
                cost[:, -1] += np.log2(max(others, 1))
                self.bits[self.first[k] * size : (self.first[k] + n_ctx) * size, j] = cost.ravel()
                below = p

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        rows, size, n = len(offsets) - 1, self.n_symbols, len(data)
        out = np.zeros((rows, len(self.langs)))
        if not n:
            return out
        s = self.symbol[LOWER[data].astype(np.int64) + 1]
        # ids of the contexts that end right before position i + 1, by order
        state = np.zeros(n, np.int64)
        lengths = np.diff(offsets)
        begins = offsets[:-1][lengths > 0]
        order = np.zeros(n, np.int8)
        order[:] = ORDER
        for k in range(ORDER):
            at = begins + k
            order[at[at < np.append(begins[1:], n)]] = k
        previous = np.empty(n, np.int64)
        previous[0], previous[1:] = 0, s[:-1]
        shorter = None
        for k in range(1, ORDER + 1):
            if k == 1:
                ids = self.lookup[0][previous]
            else:
                older = np.empty(n, np.int32)
                older[0], older[1:] = -1, shorter[:-1]
                ids = np.where(older >= 0, self.lookup[k - 1][np.maximum(older, 0) * np.int64(size) + previous], np.int32(-1))
            ids[order < k] = -1
            known = ids >= 0
            state[known] = ids[known] + self.first[k]
            shorter = ids
        bits = self.bits[state * size + s]
        filled = lengths > 0
        out[filled] = np.add.reduceat(bits, begins, axis=0, dtype=np.float64)
        return out


def train(documents: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[FrozenTrees]:
    """documents: doc_id, text, lang of the rows that may be learned from. Groups of languages, in the order of their names."""
    labelled = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = materialize(labelled.groupBy("lang").agg(F.count("*").alias("n_lang")), "languages")
    langs = sorted(r["lang"] for r in sizes.select("lang").collect())  # one name a language
    trees, whole = [], 10**12
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.col("text"))), F.lit(whole))
    for lo in range(0, len(langs), LANGS_AT_ONCE):
        some = F.broadcast(sizes.where(F.col("lang").isin(langs[lo : lo + LANGS_AT_ONCE])))  # LANGS_AT_ONCE rows
        chosen = labelled.join(some, "lang").where(draw < F.ceil(F.lit(float(sample_docs) * whole) / F.col("n_lang")))
        grams = count_grams(chosen).toPandas()  # the different grams of a bounded sample
        if len(grams):
            names = sorted(grams["lang"].unique())
            trees.append(FrozenTrees(names, np.searchsorted(names, grams["lang"].to_numpy(str)), grams["gram"].to_numpy(np.int64), grams["n"].to_numpy(np.float64)))
    return trees


# ---------------------------------------------------------------- scoring


def identify(documents: DataFrame, trees: list[FrozenTrees], bits: str | None = None) -> DataFrame:
    """All columns of documents, and lang_pred string, score double (the posterior of that language under equal priors). `bits` names a
    further column: the code length in bits that the nearest language gives a byte of the text, null where there is no byte or language.
    The posterior only compares the learned languages; the code length tells whether a text is in any of them."""
    columns = [c for c in documents.columns if c not in ("lang_pred", "score", bits)]
    out = documents.select(*columns)
    if not trees:
        none = {bits: F.lit(None).cast("double")} if bits else {}
        return out.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), **none})
    # best: bits under the best language so far; mass: sum of 2^(best - bits) over all so far
    carried, held = ["lang_pred", "best", "mass"], None
    schema = extended(out, "lang_pred string, best double, mass double")
    at = columns.index("text")
    for k, group in enumerate(trees):
        if held is not None:  # of several groups, each pass is written before the next table is held
            out = materialize(out, "code-lengths")
            held.unpersist()
        held = shared = documents.sparkSession.sparkContext.broadcast(group)  # statistics of LANGS_AT_ONCE bounded samples

        def score(batches, shared=shared, fresh=k == 0):
            import pyarrow as pa

            trees = shared.value
            names = np.array(trees.langs, object)
            letters = np.zeros(256, bool)
            letters[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
            for batch in batches:
                text = batch.column(at)
                data, offsets = string_buffers(text)
                pred, best, mass = np.full(len(text), UNKNOWN, object), np.zeros(len(text)), np.full(len(text), np.inf)
                for i, j, part, off in slices(data, offsets):
                    bits = trees.code_lengths(part, off)
                    sums = np.append(0, np.cumsum(letters[part]))[off]
                    has = np.diff(sums) > 0
                    for r in np.flatnonzero(~has & (np.diff(off) > 0)):
                        has[r] = any(map(str.isalpha, bytes(part[off[r] : off[r + 1]]).decode("utf-8", "replace")))
                    least = bits.min(1)
                    pred[i:j] = np.where(has, names[bits.argmin(1)], UNKNOWN)
                    best[i:j] = least
                    mass[i:j] = np.where(has, np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1), np.inf)
                if not fresh:
                    before = len(columns)
                    old_pred, old, old_mass = np.array(batch.column(before).to_pylist(), object), np.asarray(batch.column(before + 1)), np.asarray(batch.column(before + 2))
                    both = np.minimum(old, best)
                    mass = old_mass * np.exp2(np.maximum(both - old, -1000)) + mass * np.exp2(np.maximum(both - best, -1000))
                    pred, best = np.where(best < old, pred, old_pred), both
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(pred, pa.string()), pa.array(best), pa.array(mass)], [*columns, *carried])

        out = out.mapInArrow(score, schema)
    size = F.octet_length("text")
    rate = [F.when(size > 0, F.col("best") / size).alias(bits)] if bits else []
    return out.select(*columns, "lang_pred", (1 / F.col("mass")).alias("score"), *rate)


#: Of the ids' checksums modulo FOLDS, the remainder that is held out from learning.
FOLDS, HELD_OUT = 4, 2


def may_learn():
    return crc_mod("doc_id", FOLDS) != HELD_OUT


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    trees = train(documents.where(may_learn()).select("doc_id", "text", "lang"))
    return identify(documents.select("doc_id", "text"), trees).select("doc_id", (~may_learn()).alias("held_out"), "lang_pred", "score")

r"""Quality rules whose cutoffs are chosen under a bound of false rejections.

1. Every text's counts are taken in one pass: words, their code points, symbols, lines, repeated lines, words in repeated 3-word
   windows. A text fails the base rules if it has under MIN_WORDS words or over half of its words lie in repeated windows.
2. The rules' cutoffs form LEVELS, from lax to strict. A text's level is the first one at which any of its rules rejects it.
3. The labelled texts that pass the base rules are the holdout. By stratum (the language, by default) their levels are counted; no
   more than a row a stratum, level and label leaves the counting.
4. A level is certified in a stratum if a share of falsely rejected good texts over RISK is refuted: the exact binomial probability
   of so few rejections at a share of RISK is at most ERROR / strata (Bonferroni's correction, over strata). Within a stratum levels are
   tested from lax to strict and the first that isn't refuted ends the tests, so that these need no correction among themselves (a
   fixed sequence). With probability 1 - ERROR, no stratum's level rejects more than RISK of its good texts.
5. Of the certified levels, the one with the most gain is taken (share of bad texts rejected, less WEIGHT times the share of good
   ones), of equals the laxest; without a gain, none.

Defined results: null and empty texts have no words and fail the base rules; texts of any length are read whole; null strata are a
stratum of their own; strata with too few labels, or none, get no level and keep all that passes the base rules; repeated rows are
judged alike and count each; a doc_id whose labels contradict one another, is null, or has labels other than 0 and 1 is not in the
holdout; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACED_WORD, byte_set, extended, mix, slices, spans, string_buffers, table, word_hashes, write_table

MIN_WORDS = 50
#: Shares and lengths are in thousandths.
RULES = {
    "symbols": ("n_symbols", "n_words", "over"),
    "duplicate_lines": ("n_dup_lines", "n_lines", "over"),
    "repeated_words": ("n_repeat_words", "n_words", "over"),
    "long_words": ("word_chars", "n_words", "over"),
    "short_words": ("word_chars", "n_words", "under"),
}
#: A row a level, from lax to strict; a cutoff for each rule.
LEVELS = (
    (2000, 900, 480, 20000, 1000),
    (1500, 850, 460, 15000, 1500),
    (1000, 800, 440, 12000, 1800),
    (700, 750, 420, 11000, 2000),
    (500, 700, 400, 10000, 2200),
    (300, 650, 380, 9500, 2400),
    (200, 600, 350, 9000, 2600),
    (150, 550, 300, 8500, 2800),
    (100, 500, 250, 8000, 3000),
    (70, 400, 200, 7500, 3200),
    (50, 300, 150, 7000, 3400),
    (30, 200, 100, 6500, 3600),
    (20, 100, 50, 6200, 3800),
)
RISK, ERROR, WEIGHT = 0.05, 0.05, 10
#: Levels of strata are broadcast up to so many strata, else joined by a shuffle.
BROADCAST_STRATA = 10_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_SYMBOL = byte_set(*((ord(c), ord(c)) for c in "#*$%&|<>"))
_LINE = ~byte_set((0x0A, 0x0A))
_AS_IS = np.arange(256, dtype=np.uint8)


# ---------------------------------------------------------------- counts


def _repeats(key: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
    return n[inverse] > 1


def count_slice(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of rows of text."""
    rows = len(offsets) - 1
    by_row = lambda mask: np.diff(np.r_[0, np.cumsum(mask, dtype=np.int64)][offsets])
    start, end, first = spans(data, offsets, SPACED_WORD)
    row = np.repeat(np.arange(rows), np.diff(first)).astype(np.uint64)
    out = {"n_words": np.diff(first), "word_chars": by_row(SPACED_WORD[data] & ((data & 0xC0) != 0x80)), "n_symbols": by_row(_SYMBOL[data])}

    h = word_hashes(data, start, end, letters=_AS_IS)
    hit = np.zeros(len(h), bool)
    if len(h) > 2:
        a = np.flatnonzero(row[2:] == row[:-2])
        twice = a[_repeats(mix(mix(mix(h[a] + row[a]) + h[a + 1]) + h[a + 2]))]
        for k in range(3):
            hit[twice + k] = True
    out["n_repeat_words"] = np.diff(np.r_[0, np.cumsum(hit, dtype=np.int64)][first])

    begin, stop, _ = spans(data, offsets, _LINE)
    worded = np.searchsorted(start, stop, "left") > np.searchsorted(start, begin, "left")
    begin, stop = begin[worded], stop[worded]
    of = np.searchsorted(offsets, begin, "right") - 1
    key = mix(word_hashes(data, begin, stop, letters=_AS_IS) + of.astype(np.uint64))
    new = np.zeros(len(key), bool)
    new[np.unique(key, return_index=True)[1]] = True
    out["n_lines"] = np.bincount(of, minlength=rows)
    out["n_dup_lines"] = np.bincount(of[~new], minlength=rows)
    return out


def count(documents: DataFrame, *carried: str) -> DataFrame:
    """The carried columns, with COUNTS (long) and base_failed boolean of each text."""

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = string_buffers(batch.column(0))
            parts = [count_slice(d, o) for _, _, d, o in slices(data, offsets)]
            made = [np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for c in COUNTS]
            n, repeated = made[0], made[COUNTS.index("n_repeat_words")]
            failed = (n < MIN_WORDS) | (2 * repeated > n)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *map(pa.array, made), pa.array(failed)], [*carried, *COUNTS, "base_failed"])

    schema = extended(documents.select(*carried), ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean")
    return documents.select("text", *carried).mapInArrow(read, schema)


def level() -> Column:
    """The first level that rejects a row of COUNTS; the number of levels if none does. Levels are ordered, so it is the least over rules."""

    def of(rule: int) -> Column:
        value, whole, side = list(RULES.values())[rule]
        cuts = F.array(*[F.lit(cut[rule]).cast("long") for cut in LEVELS])
        passes = lambda c: F.col(value) * 1000 <= c * F.col(whole) if side == "over" else F.col(value) * 1000 >= c * F.col(whole)
        return F.size(F.filter(cuts, passes))

    return F.least(*[of(r) for r in range(len(RULES))])


# ---------------------------------------------------------------- certified levels


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of n trials of probability p, 0 < p < 1; 1 where k is at or over the mean, where no test needs it.

    Summed from the largest term down, until terms no longer count.
    """
    if k >= n * p:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    total, i = term, k
    while i > 0 and term > total * 1e-18:
        term *= i * (1 - p) / ((n - i + 1) * p)
        total += term
        i -= 1
    return total


def choose(good: list[int], bad: list[int], error: float, risk: float = RISK, weight: int = WEIGHT) -> tuple[int | None, int]:
    """good, bad: how many texts of the holdout each level is the first to reject, and at the end those that none rejects. Gives the level
    taken (or none), and how many levels are certified."""
    n_good, n_bad, best, gain, certified = sum(good), sum(bad), None, 0, 0
    lost = caught = 0
    for k in range(len(good) - 1):
        lost, caught = lost + good[k], caught + bad[k]
        if binomial_tail(lost, n_good, risk) > error:
            break
        certified = k + 1
        if (now := caught * n_good - weight * lost * n_bad) > gain:
            best, gain = k, now
    return best, certified


def holdout(counted: DataFrame, labels: DataFrame, stratum: str) -> DataFrame:
    """stratum, level int, good long, bad long: the labelled rows that pass the base rules."""
    label = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"), F.count_if(F.col("quality").isNull()).alias("no"))
    known = label.where("low = high AND low IN (0, 1) AND no = 0").select(F.col("doc_id").alias("labelled"), F.col("low").alias("quality"))
    met = counted.where("NOT base_failed").join(known, F.col("doc_id") == F.col("labelled"))
    return met.groupBy(F.col(stratum).alias("stratum"), level().alias("level")).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))


def certify(held: DataFrame, error: float = ERROR, risk: float = RISK, weight: int = WEIGHT) -> DataFrame:
    """A holdout's counts -> stratum, taken int (null: no level), certified int, n_good long, n_bad long."""
    strata = held.select("stratum").distinct().count()
    share, n = error / max(strata, 1), len(LEVELS) + 1
    rows = held.groupBy("stratum").agg(F.collect_list(F.struct("level", "good", "bad")).alias("levels"))  # a row a level at most

    def pick(batches):
        import pyarrow as pa

        for batch in batches:
            got = []
            for levels in batch.column(1).to_pylist():
                good, bad = [0] * n, [0] * n
                for x in levels:
                    good[x["level"]], bad[x["level"]] = x["good"], x["bad"]
                got.append((*choose(good, bad, share, risk, weight), sum(good), sum(bad)))
            cols = list(zip(*got)) if got else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["stratum", "taken", "certified", "n_good", "n_bad"])

    return rows.mapInArrow(pick, extended(rows.select("stratum"), "taken int, certified int, n_good long, n_bad long"))


def judge(counted: DataFrame, chosen: DataFrame, stratum: str) -> DataFrame:
    """counted with level int, taken int (of its stratum) and kept boolean."""
    few = chosen.count() <= BROADCAST_STRATA
    chosen = chosen.select(F.col("stratum").alias("_stratum"), "taken")
    met = counted.join(F.broadcast(chosen) if few else chosen, F.col(stratum).eqNullSafe(F.col("_stratum")), "left").drop("_stratum")
    return met.withColumn("level", level()).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("level") <= F.col("taken"), F.lit(False)))


def filter_quality(documents: DataFrame, labels: DataFrame, stratum: str = "lang", error: float = ERROR, risk: float = RISK, weight: int = WEIGHT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, stratum, COUNTS, base_failed, level, taken, kept of every document; stratum, taken, certified, n_good, n_bad)."""
    spark = documents.sparkSession
    rows = documents.select("text", "doc_id", F.col(stratum).alias("stratum"))
    counted = spark.read.parquet(write_table(count(rows, "doc_id", "stratum"), "rule-counts"))  # texts are read once
    chosen = spark.read.parquet(write_table(certify(holdout(counted, labels.select("doc_id", "quality"), "stratum"), error, risk, weight), "rule-levels"))
    return judge(counted, chosen, "stratum"), chosen


def op12_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, _ = filter_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    """The same in SQL: counts by regular expressions and windows of words, certified levels by sums of binomial terms."""
    n, rules = len(LEVELS), list(RULES.values())
    least = []
    for r, (value, whole, side) in enumerate(rules):
        cuts = "[" + ", ".join(str(cut[r]) for cut in LEVELS) + "]"
        least.append(f"len(list_filter({cuts}, lambda c: {value} * 1000 {'<=' if side == 'over' else '>='} c * {whole}))")
    word = r"[^\x20\x09-\x0D]+"
    return f"""WITH w AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
tri AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS n FROM tri) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(0, 3) r(k) GROUP BY rid),
lines AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS l FROM w),
c AS MATERIALIZED (SELECT rid, doc_id, lang, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w JOIN lines USING (rid) LEFT JOIN rep USING (rid)),
f AS MATERIALIZED (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, least({', '.join(least)}) AS level FROM c),
known AS (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY doc_id HAVING min(quality) = max(quality) AND count(quality) = count(*) AND min(quality) IN (0, 1)),
h AS (SELECT lang, level, quality FROM f JOIN known USING (doc_id) WHERE NOT base_failed),
s AS (SELECT lang, k, count(*) FILTER (quality = 1) AS n_good, count(*) FILTER (quality = 0) AS n_bad, count(*) FILTER (quality = 1 AND level <= k) AS lost, count(*) FILTER (quality = 0 AND level <= k) AS caught
  FROM h, range(0, {n}) r(k) GROUP BY lang, k),
p AS (SELECT *, CASE WHEN lost >= n_good * {RISK} THEN 1.0 ELSE list_sum(list_transform(range(0, lost + 1), lambda i: exp(lgamma(n_good + 1) - CASE WHEN i > 0 THEN lgamma(i + 1) ELSE 0 END - lgamma(n_good - i + 1) + i * ln({RISK}) + (n_good - i) * ln(1 - {RISK})))) END AS tail FROM s),
t AS (SELECT *, bool_and(tail <= {ERROR} / (SELECT count(*) FROM (SELECT DISTINCT lang FROM h))) OVER (PARTITION BY lang ORDER BY k) AS certified, caught * n_good - {WEIGHT} * lost * n_bad AS gain FROM p),
taken AS (SELECT lang, arg_min(k, -gain * {n} + k) AS taken FROM t WHERE certified AND gain > 0 GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(level <= taken, false) AS kept FROM f LEFT JOIN taken ON f.lang IS NOT DISTINCT FROM taken.lang"""


ORACLE = _oracle()

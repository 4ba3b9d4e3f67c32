"""Document quality from a linear-chain conditional random field over lines.

Each line that is not empty is a node with label good or bad. Its features are shape statistics of the line and of the lines
before and after it; a 2 x 2 transition matrix ties neighbours. Forward-backward gives each line's marginal probability of being
good; the marginals, weighted by line length, are a document's quality, and a logistic curve maps that to the score.

Training: lines carry their document's label, so only like-to-like neighbours are ever observed, and the transitions learn how far
neighbours lean on each other. It takes whole labelled documents in the order of their ids' hashes: at most TRAIN_DOCS, and no
more than have TRAIN_LINES lines together (a document that goes beyond ends the sample; one that alone has more is passed over).
This bounds what the driver holds. Scoring reads every whole text, in one pass without a shuffle; lines of long chains are worked off
in runs side by side, so a text of a million lines takes some thousand steps.

Defined results: null or empty text, or text of line ends alone, gets the share of label 1 in training (0.5 without training
rows); null labels are not learned from; of contradictory labels for one doc_id the smaller counts, and of different texts under one
doc_id one is learned from, the same on every run; repeated rows are scored alike;
an empty table gives no rows; extra columns are kept by `score_quality`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACED_WORD, byte_set, crc_mod, extended, slices, spans, string_buffers, table, word_hashes

TRAIN_DOCS = 4000
TRAIN_LINES = 150_000
#: Lines of a chain in training; runs of a long chain in scoring.
SEGMENT = 32
RUN = 512
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0

NEWLINE = 0x0A
#: Byte classes whose share of a line is a feature.
CLASSES = [
    byte_set((0x41, 0x5A)),  # upper case
    byte_set((0x61, 0x7A)),  # lower case
    byte_set((0x30, 0x39)),  # digits
    byte_set((0x80, 0xFF)),  # outside ASCII
    byte_set((0x20, 0x20), (0x09, 0x09)),  # blanks
    byte_set((0x2E, 0x2E)),  # full stops
    byte_set((0x2C, 0x2C)),  # commas
    byte_set((0x21, 0x21), (0x3F, 0x3F)),  # ! and ?
    byte_set((0x7C, 0x7C), (0x09, 0x09)),  # column marks
    byte_set((0x23, 0x26), (0x2A, 0x2A), (0x40, 0x40), (0x5E, 0x5E), (0x7E, 0x7E)),  # signs
    byte_set((0x27, 0x29), (0x22, 0x22), (0x2D, 0x2D), (0x3A, 0x3B)),  # other punctuation of prose
    byte_set((0x2F, 0x2F), (0x3C, 0x3E), (0x5B, 0x5D), (0x5F, 0x60), (0x7B, 0x7B), (0x7D, 0x7D), (0x2B, 0x2B)),  # of code
]
OWN = len(CLASSES) + 7
FEATURES = 3 * OWN + 2


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features [lines, FEATURES], lengths in bytes, and for each text the number of lines before it. Empty lines are no nodes."""
    n = len(data)
    inside = data != NEWLINE
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets, "left")
    lines = len(start)
    if not lines:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64), first
    length = end - start
    own = np.zeros((lines, OWN), np.float32)
    cuts = np.stack([start, end], 1).ravel()
    cuts = cuts[:-1] if end[-1] == n else cuts
    for k, table_ in enumerate(CLASSES):
        own[:, k] = np.add.reduceat(table_[data].astype(np.int32), cuts)[::2] / length
    words = own[:, 4] * length + 1
    k = len(CLASSES)
    own[:, k] = np.log1p(length) / 8
    own[:, k + 1] = np.minimum(length / words, 40) / 10
    own[:, k + 2] = (data[start] >= 0x61) & (data[start] <= 0x7A)
    own[:, k + 3] = data[end - 1] == 0x2E
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    h = word_hashes(data, start, end)
    order = np.lexsort((h, doc))
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twin = np.zeros(lines, bool)
    twin[order[1:][same]] = twin[order[:-1][same]] = True
    own[:, k + 4] = twin
    own[:, k + 5] = np.log1p(np.diff(first))[doc] / 5
    own[:, k + 6] = _echoes(data, offsets, start, lines) / words
    out = np.zeros((lines, FEATURES), np.float32)
    out[:, :OWN] = own
    has = np.zeros(lines, bool)
    has[1:] = doc[1:] == doc[:-1]
    at = np.flatnonzero(has)
    out[at, OWN : 2 * OWN] = own[at - 1]
    out[at - 1, 2 * OWN : 3 * OWN] = own[at]
    out[:, -2] = ~has
    out[:, -1] = np.append(~has[1:], True)
    return out, length, first


def _echoes(data: np.ndarray, offsets: np.ndarray, line_start: np.ndarray, lines: int) -> np.ndarray:
    """How many words of each line repeat the word before them."""
    start, end, _ = spans(data, offsets, SPACED_WORD)
    h = word_hashes(data, start, end)
    line = np.searchsorted(line_start, start, "right") - 1
    same = np.flatnonzero((h[1:] == h[:-1]) & (line[1:] == line[:-1])) + 1
    return np.bincount(line[same], minlength=lines)


def chain_marginals(logit: np.ndarray, first: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of each line of chains first[i]..first[i+1]; also each chain's log normaliser and the expected transitions [2, 2]."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    m = np.exp(transition - transition.max())
    p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    emit = np.stack([1 - p, p], 1)
    alpha, beta = np.empty_like(emit), np.ones_like(emit)
    log_z = np.zeros(len(size))
    steps = int(size[0]) if len(size) else 0
    live = [int(np.searchsorted(-size, -t, "left")) for t in range(steps)]  # chains longer than t
    for t in range(steps):
        at = begin[: live[t]] + t
        a = emit[at] * (alpha[at - 1] @ m if t else 0.5)
        z = a.sum(1)
        alpha[at] = a / z[:, None]
        log_z[: live[t]] += np.log(z)
    expected = np.zeros((2, 2))
    for t in range(steps - 1, 0, -1):
        at = begin[: live[t]] + t
        right = emit[at] * beta[at]
        pair = alpha[at - 1][:, :, None] * m[None] * right[:, None, :]
        expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
        b = right @ m.T
        beta[at - 1] = b / b.sum(1, keepdims=True)
    both = alpha * beta
    out_z = np.empty(len(size))
    out_z[order] = log_z
    return both[:, 1] / both.sum(1), out_z, expected


def good_shares(logit: np.ndarray, first: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """chain_marginals' P(good), also of long chains: these are cut into runs of RUN lines. Of each run, the products of the chain's 2 x 2
    steps are made up to and from every line, side by side for all runs; vectors are then carried from run to run."""
    size = np.diff(first)
    if not len(size) or size.max() <= RUN:
        return chain_marginals(logit, first, transition)[0]
    ends = [np.append(np.arange(a, b, RUN), b) for a, b in zip(first[:-1].tolist(), first[1:].tolist()) if b > a]
    begin = np.concatenate([e[:-1] for e in ends])
    length = np.concatenate([np.diff(e) for e in ends])
    number = np.concatenate([np.arange(len(e) - 1) for e in ends])  # of a run in its chain
    m = np.exp(transition - transition.max())
    p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    emit = np.stack([1 - p, p], 1)
    step = m[None] * emit[:, None, :]  # from the line before to this one
    upto, onward = np.empty((len(logit), 2, 2)), np.empty((len(logit), 2, 2))
    order = np.argsort(-length, kind="stable")
    by = -length[order]
    live = [order[: int(np.searchsorted(by, -t, "left"))] for t in range(int(length.max()))]  # runs longer than t
    for t, runs in enumerate(live):
        at = begin[runs] + t
        x = step[at] if t == 0 else upto[at - 1] @ step[at]
        upto[at] = x / x.sum((1, 2), keepdims=True)
    onward[begin + length - 1] = np.eye(2)
    for t in range(len(live) - 1, 0, -1):
        at = begin[live[t]] + t
        x = step[at] @ onward[at]
        onward[at - 1] = x / x.sum((1, 2), keepdims=True)
    start, stop = np.empty((len(begin), 2)), np.empty((len(begin), 2))  # before a run's first line; after its last
    lasts = begin + length - 1
    by_number = [np.flatnonzero(number == k) for k in range(int(number.max()) + 1)] if len(ends) < len(begin) else [np.arange(len(begin))]
    # the first step has even odds instead of a line before it: a start vector that m maps to (0.5, 0.5)
    first_vector = np.linalg.solve(m.T, np.array([0.5, 0.5])) if abs(np.linalg.det(m)) > 1e-12 else None
    for k, runs in enumerate(by_number):
        if k == 0:
            if first_vector is None:  # a flat m: any start will do, up to scale
                start[runs] = 0.5
            else:
                start[runs] = first_vector
            continue
        a = np.einsum("ri,rij->rj", start[runs - 1], upto[lasts[runs - 1]])
        start[runs] = a / a.sum(1, keepdims=True)
    final = np.append(number[1:] == 0, True)
    for k in range(len(by_number) - 1, -1, -1):
        runs = by_number[k]
        stop[runs[final[runs]]] = 1.0
        inner = runs[~final[runs]]
        nxt = begin[inner + 1]
        b = np.einsum("rij,rj->ri", step[nxt] @ onward[nxt], stop[inner + 1])
        stop[inner] = b / b.sum(1, keepdims=True)
    run = np.repeat(np.arange(len(begin)), length)
    alpha = np.einsum("ni,nij->nj", start[run], upto)
    beta = np.einsum("nij,nj->ni", onward, stop[run])
    both = alpha * beta
    return both[:, 1] / both.sum(1)


@dataclass
class LineField:
    """A trained field; plain numbers, so it travels in a task's closure."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    transition: np.ndarray
    curve: tuple[float, float]
    prior: float

    def quality(self, x: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Length-weighted mean marginal of each text; nan without lines."""
        logit = (x - self.mean) / self.scale @ self.weight + self.bias
        good = good_shares(logit.astype(np.float64), first, self.transition)
        total, share = np.append(0, np.cumsum(length)), np.append(0, np.cumsum(length * good))
        with np.errstate(invalid="ignore"):
            return np.diff(share[first]) / np.diff(total[first])

    def score(self, q: np.ndarray) -> np.ndarray:
        a, b = self.curve
        q = np.clip(q, 1e-6, 1 - 1e-6)
        return np.where(np.isnan(q), self.prior, 1 / (1 + np.exp(-(a * np.log(q / (1 - q)) + b))))


def fit(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rounds: int = 150, l2: float = 1e-3) -> LineField:
    """texts: (features, lengths) of each document's lines, in order."""
    prior = float(labels.mean()) if len(labels) else 0.5
    sizes = np.array([len(l) for _, l in texts], np.int64)
    if not sizes.sum() or prior in (0.0, 1.0):
        zero = np.zeros(FEATURES)
        return LineField(zero, zero + 1, zero, float(np.log((prior + 0.01) / (1.01 - prior))), np.zeros((2, 2)), (1.0, 0.0), prior)
    x = np.concatenate([f for f, _ in texts])
    length = np.concatenate([l for _, l in texts])
    ends = np.append(0, np.cumsum(sizes))
    y = np.repeat(labels.astype(np.float64), sizes)
    mean, scale = x.mean(0, dtype=np.float64).astype(np.float32), x.std(0, dtype=np.float64).astype(np.float32) + np.float32(1e-3)
    x -= mean
    x /= scale
    # chains: runs of SEGMENT lines, so that a step of the recursion has many chains
    first = np.unique(np.concatenate([np.append(np.arange(a, b, SEGMENT), b) for a, b in zip(ends[:-1], ends[1:])]))
    inner = np.ones(len(y), bool)
    inner[first[:-1]] = False
    at = np.flatnonzero(inner)
    observed = np.zeros((2, 2))
    np.add.at(observed, (y[at - 1].astype(int), y[at].astype(int)), 1)
    n = len(y)
    theta = np.zeros(x.shape[1] + 1 + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        w, b, t = theta[: x.shape[1]], theta[x.shape[1]], theta[-4:].reshape(2, 2)
        good, _, expected = chain_marginals((x @ w.astype(np.float32)).astype(np.float64) + b, first, t)
        miss = good - y
        grad = np.concatenate([miss.astype(np.float32) @ x / n + l2 * w, [miss.mean()], ((expected - observed) / n).ravel() + l2 * theta[-4:]])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    out = LineField(mean, scale, theta[: x.shape[1]], float(theta[x.shape[1]]), theta[-4:].reshape(2, 2), (1.0, 0.0), prior)
    q = out.quality(np.concatenate([f for f, _ in texts]), length, ends)
    known = ~np.isnan(q)
    out.curve = _logistic_curve(np.clip(q[known], 1e-6, 1 - 1e-6), labels[known].astype(np.float64))
    return out


def _logistic_curve(q: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps for P(1) = sigmoid(a * logit(q) + b), lightly ridged; a stays positive."""
    z = np.stack([np.log(q / (1 - q)), np.ones_like(q)], 1)
    c = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ c, -30, 30)))
        g = z.T @ (p - y) + 1e-2 * (c - [1.0, 0.0])
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        c = c - np.linalg.solve(h, g)
    return max(float(c[0]), 1e-3), float(c[1])


def _sample_features(rows: DataFrame) -> DataFrame:
    """label, text -> label int, x binary, length binary of all lines."""

    def make(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = string_buffers(batch.column(1))
            for i, j, part, off in slices(data, offsets):
                x, length, first = line_features(part, off)
                cuts = list(zip(first[:-1], first[1:]))
                xs, ls = [x[a:b].tobytes() for a, b in cuts], [length[a:b].astype(np.int64).tobytes() for a, b in cuts]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(xs, pa.binary()), pa.array(ls, pa.binary())], ["label", "x", "length"])

    return rows.select("label", "text").mapInArrow(make, "label int, x binary, length binary")


def training_rows(documents: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> DataFrame:
    """label, text of the sample: at most train_docs rows with train_lines lines together."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)  # at most train_docs rows
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    some = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(lines <= train_lines)
    one = some.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    upto = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # over the sample alone
    return one.withColumn("upto", F.sum(lines).over(upto)).where(F.col("upto") <= train_lines).select("label", "text")


def train(documents: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> LineField:
    """documents: doc_id, text. labels: doc_id, quality, of the rows that may be learned from."""
    rows = _sample_features(training_rows(documents, labels, train_docs, train_lines)).collect()  # bounded by both parameters
    texts = [(np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES), np.frombuffer(r["length"], np.int64)) for r in rows]
    order = sorted(range(len(rows)), key=lambda k: (bytes(rows[k]["length"]), bytes(rows[k]["x"])))  # the same whatever the partitions
    return fit([texts[k] for k in order], np.array([rows[k]["label"] for k in order], np.float64))


def score_quality(documents: DataFrame, model: LineField, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of documents, and score double, predicted int."""
    columns = [c for c in documents.columns if c not in ("score", "predicted")]
    kept = documents.select(*columns)
    at = columns.index("text")

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = string_buffers(batch.column(at))
            got = [model.score(model.quality(*line_features(part, off))) for _, _, part, off in slices(data, offsets)]
            s = np.concatenate(got) if got else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*columns, "score", "predicted"])

    return kept.mapInArrow(score, extended(kept, "score double, predicted int"))


def is_held_out():
    return crc_mod("doc_id", FOLDS) == HELD_OUT


def op4_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = train(documents, labels.where(~is_held_out()).select("doc_id", "quality"))
    return score_quality(documents, model).select("doc_id", is_held_out().alias("held_out"), "score", "predicted")

"""Best-fit packing, planned on the histogram of lengths.

1. Documents are tokenised once; only documents longer than the capacity are cut (the first piece takes the remainder, the
   others are full). The piece rows (no token ids, unless asked for) are written to the shared folder.
2. The histogram of piece lengths has at most `capacity` rows whatever the corpus; best-fit decreasing runs over these counts
   on the driver and gives a plan of segments "ranks a.. of length l go to sequences s.., k in each, from offset o".
3. Every piece finds its rank within its length (counted in salted runs, so that one common length does not land in one task)
   and takes the planned slot.

Defined results: a null text counts as empty, which is one piece with the end token alone; null and repeated doc_ids are
pieces like any other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import extended, materialize, table

CAPACITY = 1024
END_ID = 2
#: The split pattern of byte-level BPE vocabularies of this kind (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts are encoded in runs of about so many characters; a run ends between a letter and a space before a letter, where tokens always end.
RUN_CHARS = 500_000
_CUT = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")
#: What PATTERN's engine takes for white space (a fixed value), and the length from which a run of it is kept from that engine, whose
#: stack grows with the run.
BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LONG_BLANKS = 20_000


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level BPE files write the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _plain_bpe(spec: dict) -> bool:
    """Whether a tokenizer file means exactly what the faster library does: byte-level pieces by PATTERN, merges in the order of the
    vocabulary, and added tokens that are cut out of the text as they stand."""
    model, split, after = spec.get("model") or {}, spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or ()
    if spec.get("normalizer") or model.get("type", "BPE") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return False
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return False
    if any(t.get(k) for t in after for k in ("single_word", "lstrip", "rstrip")) or any(not t["content"] or any(c.isspace() for c in t["content"]) for t in after):
        return False
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get(a + b, -1) for a, b in pairs]
    letters, special = _byte_letters(), {t["content"] for t in after}
    known = {*letters, *(a + b for a, b in pairs)}
    return all(x < y for x, y in zip(made, made[1:])) and all(w in known or w in special for w in model["vocab"]) and all(c in model["vocab"] for c in letters)


@functools.lru_cache(maxsize=2)
def load_encoding(path: str):
    """A function from a text to its ids, as the tokenizers library gives them with add_special_tokens=False: the texts of added tokens
    become their ids. The vocabulary runs through the faster of the two installed libraries where the file allows it."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if not _plain_bpe(spec):
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    import tiktoken

    letters = _byte_letters()
    special = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
    ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    fast = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    if not special:
        return lambda text: _ordinary(fast, text)
    cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")")

    def ids(text: str) -> list[int]:
        if not any(s in text for s in special):
            return _ordinary(fast, text)
        out: list[int] = []
        for k, part in enumerate(cut.split(text)):
            out += [special[part]] if k % 2 else _ordinary(fast, part)
        return out

    return ids


def _ordinary(fast, text: str) -> list[int]:
    """Ids of a text without added tokens. A long run of white space is one piece, but for its last character where something follows it."""
    if len(text) < LONG_BLANKS:
        return fast.encode_ordinary(text)
    out, at = [], 0
    for run in re.finditer(f"[{BLANKS}]{{{LONG_BLANKS},}}", text):
        to = run.end() - (run.end() < len(text))
        out += fast.encode_ordinary(text[at : run.start()]) + fast._encode_single_piece(text[run.start() : to])
        at = to
    return out + fast.encode_ordinary(text[at:])


def encode(path: str, text: str) -> np.ndarray:
    ids = load_encoding(path)
    if len(text) <= RUN_CHARS:
        return np.array(ids(text), np.uint32)
    parts, at = [], 0
    while at < len(text):
        cut = _CUT.search(text, at + RUN_CHARS)  # added tokens hold no blanks, so none is cut
        to = cut.start() if cut else len(text)
        parts.append(np.array(ids(text[at:to]), np.uint32))
        at = to
    return np.concatenate(parts)


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece int, start long, length long, ids_crc32 long (and ids binary, little-endian uint32, with keep_ids)."""
    path = path or default_tokenizer_path()

    def tokenise(batches):
        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            out: dict[str, list] = {k: [] for k in ("row", "piece", "start", "length", "crc", "ids")}

            def made():
                cols = [ids.take(pa.array(out["row"], pa.int64())), pa.array(out["piece"], pa.int32()), pa.array(out["start"], pa.int64()), pa.array(out["length"], pa.int64()), pa.array(out["crc"], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    cols.append(pa.array(out["ids"], pa.binary()))
                    names.append("ids")
                return pa.RecordBatch.from_arrays(cols, names)

            for row in range(len(texts)):
                tokens = np.append(encode(path, texts[row].as_py() or ""), np.uint32(end_id)).astype("<u4")
                for k, (start, length) in enumerate(cut_points(len(tokens), capacity)):
                    raw = tokens[start : start + length].tobytes()
                    for name, v in (("row", row), ("piece", k), ("start", start), ("length", length), ("crc", zlib.crc32(raw))):
                        out[name].append(v)
                    if keep_ids:
                        out["ids"].append(raw)
            yield made()

    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return documents.select("doc_id", "text").mapInArrow(tokenise, schema)


def plan_best_fit(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over counts. Rows: length, first rank, pieces per sequence, first sequence, first offset.

    Ranks r from `first rank` up to the next row's of that length go to sequence first + (r - first rank) // per, at
    offset + (r - first rank) % per * length. Sequences of one history are kept as ranges, so the work depends on the number
    of different lengths only.
    """
    free: dict[int, list[list[int]]] = {}  # room left -> ranges [first sequence, number]
    rows, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        for room in sorted(r for r in free if r >= length):
            ranges = free.pop(room)
            per = room // length
            while ranges and left:
                first, n = ranges.pop()
                use = min(n, -(-left // per))
                rows.append((length, rank, per, first, capacity - room))
                put = min(left, use * per)
                full = put // per
                if full:
                    free.setdefault(room - per * length, []).append([first, full])
                if put % per:
                    free.setdefault(room - put % per * length, []).append([first + full, 1])
                if use < n:
                    ranges.append([first + use, n - use])
                left, rank = left - put, rank + put
            if ranges:
                free.setdefault(room, []).extend(ranges)
            if not left:
                break
        if left:
            per = capacity // length
            full = left // per
            rows.append((length, rank, per, sequences, 0))
            if full:
                free.setdefault(capacity - per * length, []).append([sequences, full])
            if left % per:
                free.setdefault(capacity - left % per * length, []).append([sequences + full, 1])
            sequences += -(-left // per)
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def with_rank_in_length(pieces: DataFrame, salts: int) -> DataFrame:
    """Adds rank long: 0, 1, ... within each length. Runs of one length are counted in `salts` parts and offset by the parts before."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("nth", F.row_number().over(within) - 1)
    return ranked.join(offsets, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("nth")).drop("salt", "base", "nth")


def pack(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents with sequence_id long and offset long (gapless from 0 in each sequence)."""
    spark = documents.sparkSession
    pieces = materialize(token_pieces(documents, path, capacity, end_id, keep_ids), "pieces")
    # at most `capacity` rows reach the driver
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = plan_best_fit(histogram, capacity)
    ranked = with_rank_in_length(pieces, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    schema, carried = extended(pieces, "sequence_id long, offset long"), pieces.columns

    def place(batches):
        import pyarrow as pa

        big = np.int64(1) << np.int64(50)
        keys = plan[:, 0] * big + plan[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(k)) for k in ("length", "rank"))
            row = plan[np.searchsorted(keys, length * big + rank, "right") - 1]
            nth = rank - row[:, 1]
            cols = [batch.column(c) for c in carried]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(row[:, 3] + nth // row[:, 2]), pa.array(row[:, 4] + nth % row[:, 2] * length)], names=[*carried, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def assemble(packed: DataFrame) -> DataFrame:
    """Packed pieces with ids -> one row a sequence: sequence_id, ids binary, doc_ids (both in order). At most one capacity of ids a row."""
    got = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    return got.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

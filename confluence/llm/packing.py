"""Best-fit packing: tokenised documents into sequences of a fixed length.

Only the histogram of piece lengths (at most SEQUENCE numbers) comes to the driver.  Patterns of
two or three lengths that fill a sequence exactly are enumerated, their repeat counts fitted to
the histogram by non-negative least squares, rounded, and what is left packed by best fit,
longest first.  The plan is a list of runs, (length, ranks) -> (sequences, offset), whose number
depends on the sequence length only.  Pieces get ranks within their length by a two-level count,
so a length that a third of all pieces have is no hot spot.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confluence.llm.bpe import VOCABULARY, codec, read_ranks
from confluence.llm.common import written
from confluence.llm.words import batches

SEQUENCE, END = 2048, 0
LONG_BLANKS = 10_000
#: Pieces of one length that share a salt, about.
SALTED = 50_000
FIT_ROUNDS = 150
_ENCODINGS: dict[str, tiktoken.Encoding] = {}


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of the tokenizer file beside a rank file: texts are cut at these before anything else."""
    with open(path.removesuffix(".tiktoken") + ".json", encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    for token in added:
        if any(token[flag] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"added token {token['content']!r} isn't matched literally")
    return {token["content"]: token["id"] for token in added}


def encoding(path: str = VOCABULARY) -> tiktoken.Encoding:
    """The encoder of this Python worker: the ranks and added tokens of ``byte_bpe_50k.json``."""
    if path not in _ENCODINGS:
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens=added_tokens(path))
    return _ENCODINGS[path]


def ids_of(text: str, own: tiktoken.Encoding, path: str = VOCABULARY) -> list[int]:
    """The ids that the tokenizer file gives ``text``, added tokens within it included.

    The encoder's pattern matcher recurses on blanks, so a text with a very long run of them goes, between its
    added tokens, through the codec of ``bpe``.
    """
    if len(text) < LONG_BLANKS or not re.search(rf"\s{{{LONG_BLANKS}}}", text):
        return own.encode(text, allowed_special="all")
    special = {token: own.encode_single_token(token) for token in own.special_tokens_set}
    parts = re.split("|".join(f"({re.escape(token)})" for token in special), text) if special else [text]
    return [i for part in parts if part for i in ([special[part]] if part in special else codec(path, public_tokenizers.PATTERN).encode(part))]


def pieces(docs: DataFrame, sequence: int = SEQUENCE, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids with END behind them, cut only beyond ``sequence``.

    The first piece takes what the full ones leave.
    """

    def run(source):
        own = encoding(path)
        for batch in batches(source, 2 << 20):
            row, piece, start, length, crc = [], [], [], [], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array(ids_of(text or "", own, path) + [END], "<u4")
                lead = len(ids) % sequence
                edges = ([0] if lead else []) + list(range(lead, len(ids), sequence)) + [len(ids)]
                for p, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    row.append(r)
                    piece.append(p)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            yield pa.record_batch([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(held: np.ndarray, sequence: int) -> np.ndarray:
    """Rows of three lengths (0: none) that sum to ``sequence``, out of lengths that occur."""
    there = held > 0
    a = np.flatnonzero(there[: sequence // 2 + 1])
    a = a[a > 0]
    pairs = np.stack([a, sequence - a, np.zeros_like(a)], axis=1)
    out = [pairs[there[pairs[:, 1]]]]
    for x in a[a <= sequence // 3]:
        y = a[(a >= x) & (a <= (sequence - x) // 2)]
        z = sequence - x - y
        ok = there[z]
        out.append(np.stack([np.full(ok.sum(), x), y[ok], z[ok]], axis=1))
    return np.concatenate(out)


def fitted(rows: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that bring the patterns' lengths near the histogram, in the least-squares sense.

    Multiplicative updates keep x non-negative: x *= (A'h) / (A'Ax).
    """
    size = len(held)
    weight = rows > 0

    def spread(x):
        return sum(np.bincount(rows[:, c], x * weight[:, c], size) for c in range(3))

    def gather(h):
        return sum(h[rows[:, c]] * weight[:, c] for c in range(3))

    x, target = np.ones(len(rows)), gather(held.astype(float))
    x *= held.sum() / max(1.0, spread(x).sum())
    for _ in range(FIT_ROUNDS):
        x *= target / np.maximum(gather(spread(x)), 1e-12)
    return x


def plan(histogram: dict[int, int], sequence: int = SEQUENCE) -> np.ndarray:
    """Runs (length, first rank, pieces, first sequence, offset), sorted by length and rank."""
    left = np.zeros(sequence + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    used, runs, sequences = np.zeros(sequence + 1, np.int64), [], 0

    def place(length, n, first, offset):
        runs.append((length, used[length], n, first, offset))
        used[length] += n
        left[length] -= n

    if left[sequence]:
        n = int(left[sequence])
        place(sequence, n, 0, 0)
        sequences = n
    rows = patterns(left, sequence)
    if len(rows):
        x = fitted(rows, left)
        order = np.argsort(-x, kind="stable")
        whole = np.floor(x).astype(np.int64)
        rest = x - whole
        for chosen, least in ((order, 0), (np.argsort(-rest, kind="stable"), 1)):  # the whole parts, then one more each
            for p in chosen:
                n = least or int(whole[p])
                if not n:
                    break
                lengths = [int(v) for v in rows[p] if v]
                n = min(n, *(int(left[v]) // lengths.count(v) for v in lengths))
                if n > 0:
                    offset = 0
                    for v in lengths:
                        place(v, n, sequences, offset)
                        offset += v
                    sequences += n
    gaps: dict[int, list[tuple[int, int]]] = {}
    bits = 0
    for length in range(sequence, 0, -1):
        while left[length]:
            fit = bits >> length
            if fit:
                gap = length + (fit & -fit).bit_length() - 1
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    bits &= ~(1 << gap)
                take = min(n, int(left[length]))
                if take < n:
                    gaps[gap].append((first + take, n - take))
                    bits |= 1 << gap
            else:
                gap, first, take = sequence, sequences, max(1, int(left[length]) // max(1, sequence // length))
                take = int(left[length]) if length * 2 > sequence else take
                sequences += take
            place(length, take, first, sequence - gap)
            if gap > length:
                gaps.setdefault(gap - length, []).append((first, take))
                bits |= 1 << (gap - length)
    runs = np.array(runs, np.int64).reshape(-1, 5)
    return runs[np.lexsort((runs[:, 1], runs[:, 0]))]


def ranked(cut: DataFrame, salts: int) -> DataFrame:
    """Adds ``rank``, 0, 1, ... within each length, from counts by (length, salt).

    The salt comes from ``row``, which is a key: repeated rows are spread like others."""
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    counted = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counted.withColumn("base", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(W.partitionBy("length", "salt").orderBy("row"))
    return salted.withColumn("place", place).join(before.drop("n"), ["length", "salt"]).withColumn("rank", F.col("base") + F.col("place") - 1)


def packed(docs: DataFrame, sequence: int = SEQUENCE, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    A null or empty text is one piece of one id, END.  Rows with null or repeated ids are packed
    like others, in any order.  An empty table gives an empty result; other columns are ignored.
    """
    cut = written(pieces(docs, sequence, doc_id, text, path).withColumn("row", F.monotonically_increasing_id()))
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``sequence`` rows
    share = cut.sparkSession.sparkContext.broadcast(plan(histogram, sequence))

    def run(source):
        runs = share.value
        name = runs[:, 0] << 44 | runs[:, 1]
        for batch in source:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            at = np.searchsorted(name, length << 44 | rank, "right") - 1
            sequences = runs[at, 3] + rank - runs[at, 1]
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequences), pa.array(runs[at, 4])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    salts = max(64, max(histogram.values(), default=0) // SALTED)
    return ranked(cut, salts).mapInArrow(run, schema)

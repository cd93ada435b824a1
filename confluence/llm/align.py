"""Cross-tokenizer alignment by a dangling-suffix transducer.

Two tokenizers cut the same bytes.  The transducer reads their tokens in turn; its state is the side that leads and
the bytes of that side's last token that the other side hasn't reached yet (the dangling suffix).  The side behind gives
the next token: it shortens the residual, closes the group by ending where it ends, or passes it, and then its own rest
dangles.  Transitions are memoised by (residual, next token), so most steps are one look-up.  Each step but a group's
first links one token of either side: the pairs whose bytes overlap.

Counts of linked id pairs are made in three steps: a document's distinct pairs are kept with it, sums are made in each task, and
pairs are counted over all tasks.  Documents then look up the most frequent pairs (BROADCAST at most) in a
broadcast array and the others through a join, so the tables' sizes bound nothing else.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluence.llm.bpe import VOCABULARY, codec, read_ranks
from confluence.llm.common import written
from confluence.llm.words import batches

PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Pairs looked up in a broadcast array: 17 bytes each.
BROADCAST = 1 << 20
#: Memoised transitions of a worker, and distinct pairs that a task sums before it hands them on.
MEMO, SUMMED = 2_000_000, 4_000_000
#: Ids of the second side take this many bits of a pair.
BITS = 16
#: Text beside which white space runs of this length go to the other encoder of the same ranks.
LONG_BLANKS = 10_000


class Side:
    """A tokenizer: ids of texts and the bytes of its tokens."""

    def __init__(self, tokens: dict[int, bytes], encode):
        self.tokens, self.encode = tokens, encode


def byte_side(path: str = VOCABULARY) -> Side:
    """Byte-level BPE ids of a space and the text; strings of special tokens are plain text."""
    ranks = read_ranks(path)
    own = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    blanks = re.compile(rf"\s{{{LONG_BLANKS}}}")

    def encode(texts):
        # that encoder's matcher recurses on blanks, so very long runs of them go through the codec
        return [codec(path, public_tokenizers.PATTERN).encode(f" {t}") if len(t) >= LONG_BLANKS and blanks.search(t) else own.encode_ordinary(f" {t}") for t in texts]

    return Side({i: t for t, i in ranks.items()}, encode)


def piece_side(path: str = PIECES) -> Side:
    """Pieces of the text with the leading space that the model adds; pieces <0xHH> are single bytes."""
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = {}
    for i in range(own.get_piece_size()):
        piece = own.id_to_piece(i)
        tokens[i] = bytes([int(piece[3:5], 16)]) if own.is_byte(i) else piece.replace("▁", " ").encode()
    return Side(tokens, lambda texts: own.encode(texts, num_threads=1))


class Transducer:
    """Aligns two token sequences of the same bytes."""

    def __init__(self, first: dict[int, bytes], second: dict[int, bytes]):
        self.tokens = (first, second)
        self.memo: dict[int, int] = {}
        #: Residuals by state number: even numbers where the first side leads; 0 is the empty residual.
        self.names: dict[tuple[int, bytes], int] = {}
        self.residuals: list[bytes] = [b"", b""]

    def state(self, leads: int, residual: bytes) -> int:
        if not residual:
            return 0
        name = self.names.get((leads, residual))
        if name is None:
            name = self.names[leads, residual] = len(self.residuals) + leads
            self.residuals += [residual, residual]
        return name

    def step(self, state: int, token: int) -> int:
        """The state after the side behind has given ``token``; ValueError where the bytes differ."""
        leads, residual = state & 1, self.residuals[state]
        data = self.tokens[1 - leads][token]
        if len(data) <= len(residual):
            if not residual.startswith(data):
                raise ValueError("the sides differ")
            return self.state(leads, residual[len(data) :])
        if not data.startswith(residual):
            raise ValueError("the sides differ")
        return self.state(1 - leads, data[len(residual) :])

    def align(self, a: list[int], b: list[int]) -> tuple[list[int], list[int], list[int]]:
        """(ends in a, ends in b, links) of the groups; a link is first id << BITS | second id."""
        if len(self.memo) > MEMO:
            self.memo, self.names, self.residuals = {}, {}, [b"", b""]
        memo, ends_a, ends_b, links = self.memo, [], [], []
        known, link, end_a, end_b = memo.get, links.append, ends_a.append, ends_b.append
        i = j = 0
        n_a, n_b = len(a), len(b)
        while i < n_a and j < n_b:
            x, y = a[i], b[j]
            i += 1
            j += 1
            link(x << BITS | y)
            # a group's first two tokens: one state for each first token, numbered below 0
            key = ~(x << BITS | y)
            state = known(key)
            if state is None:
                state = memo[key] = self.step(self.state(0, self.tokens[0][x]), y)
            while state:
                if state & 1:  # the second side leads
                    if i == n_a:
                        raise ValueError("the first side ends early")
                    x = a[i]
                    i += 1
                    key = state << 20 | x
                else:
                    if j == n_b:
                        raise ValueError("the second side ends early")
                    y = b[j]
                    j += 1
                    key = state << 20 | y
                link(x << BITS | y)
                after = known(key)
                if after is None:
                    after = memo[key] = self.step(state, x if state & 1 else y)
                state = after
            end_a(i)
            end_b(j)
        if i < n_a or j < n_b:
            raise ValueError("one side ends early")
        return ends_a, ends_b, links


class Aligner:
    """Both sides and the transducer of a Python worker."""

    def __init__(self, first: Side, second: Side):
        if max(*first.tokens, *second.tokens) >= 1 << BITS:
            raise ValueError(f"ids of over {BITS} bits")
        self.sides = (first, second)
        self.transducer = Transducer(first.tokens, second.tokens)
        text = lambda side, ends: [{i: b"%d%s" % (i, end) for i in side.tokens} for end in ends]
        self.words = [*text(first, (b",", b"|")), *text(second, (b",", b";"))]

    def groups(self, a, b, ends_a, ends_b) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group, first side first."""
        inner_a, last_a, inner_b, last_b = self.words
        out, i, j = [], 0, 0
        put = out.append
        for m, n in zip(ends_a, ends_b):
            if m - i > 1:
                out.extend([inner_a[x] for x in a[i : m - 1]])
            put(last_a[a[m - 1]])
            if n - j > 1:
                out.extend([inner_b[y] for y in b[j : n - 1]])
            put(last_b[b[n - 1]])
            i, j = m, n
        return b"".join(out)[:-1]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(first: str, second: str) -> Aligner:
    """An aligner of this Python worker."""
    if (first, second) not in _ALIGNERS:
        _ALIGNERS[first, second] = Aligner(byte_side(first), piece_side(second))
    return _ALIGNERS[first, second]


LINKED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"


def linked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", first: str = VOCABULARY, second: str = PIECES) -> DataFrame:
    """Each document's tokens, groups and links (columns as in LINKED); pairs are distinct and ascend, times says how often each."""

    def run(source):
        own = aligner(first, second)
        side_a, side_b = own.sides
        bytes_a, bytes_b = side_a.tokens.__getitem__, side_b.tokens.__getitem__
        for batch in batches(source, 2 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = np.zeros((4, len(texts)), np.int64)
            digests, pairs, times, edges = [""] * len(texts), [], [], [0]
            for r, (t, a, b) in enumerate(zip(texts, side_a.encode(texts), side_b.encode(texts))):
                size = 0
                if t:
                    whole = f" {t}".encode()
                    if b"".join(map(bytes_a, a)) == whole and b"".join(map(bytes_b, b)) == whole:
                        ends_a, ends_b, links = own.transducer.align(a, b)
                        counts[:, r] = len(a), len(b), len(ends_a), len(links)
                        digests[r] = hashlib.sha256(own.groups(a, b, ends_a, ends_b)).hexdigest()
                        found, n = np.unique(np.array(links, np.int64), return_counts=True)
                        pairs.append(found)
                        times.append(n)
                        size = len(found)
                edges.append(edges[-1] + size)
            lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.uint32).view(np.int32))) for x in (pairs, times)]
            yield pa.record_batch([batch.column(0), *(pa.array(x) for x in counts), pa.array(digests, pa.string()), *lists], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return docs.mapInArrow(run, LINKED)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """A list column's values and the offsets of its rows in them."""
    offsets = np.asarray(column.offsets)
    return np.asarray(column.values)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): how many links have the pair, and whether no pair of its second id has more."""

    def run(source):
        keys, sums, waiting, size = np.zeros(0, np.int32), np.zeros(0, np.int64), [], 0

        def merged():
            every, n = (np.concatenate(x) for x in zip((keys, sums), *waiting))
            names, at = np.unique(every, return_inverse=True)
            return names, np.bincount(at, n, len(names)).astype(np.int64)

        for batch in source:
            pairs, times = _flat(batch.column(0))[0], _flat(batch.column(1))[0]
            waiting.append((pairs, times.astype(np.int64)))
            size += len(pairs)
            if size >= SUMMED:
                keys, sums = merged()
                waiting, size = [], 0
                if len(keys) >= SUMMED:
                    yield pa.record_batch([pa.array(keys), pa.array(sums)], ["pair", "n"])
                    keys, sums = keys[:0], sums[:0]
        keys, sums = merged()
        yield pa.record_batch([pa.array(keys), pa.array(sums)], ["pair", "n"])

    counted = written(rows.select("pairs", "times").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")))
    second = F.col("pair").bitwiseAND(F.lit((1 << BITS) - 1))
    most = counted.groupBy(second.alias("second")).agg(F.max("n").alias("most"))  # a row for each of the second vocabulary's ids at most
    return counted.join(F.broadcast(most), second == F.col("second")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent(counts: DataFrame, limit: int = BROADCAST) -> tuple[int, list[np.ndarray]]:
    """The least count, a power of two, that at most ``limit`` pairs reach, and these pairs as sorted arrays."""
    level = F.length(F.bin("n"))  # at most 64 of them
    n_of = {r.level: r.of for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("of")).collect()}
    least, so_far = 65, 0
    for at in sorted(n_of, reverse=True):
        so_far += n_of[at]
        if so_far > limit:
            break
        least = at
    held = counts.filter(level >= least).toArrow()
    pair, n, best = (held.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pair)
    return least, [pair[order], n[order], best[order]]


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", first: str = VOCABULARY, second: str = PIECES, limit: int = BROADCAST) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document.

    Null and empty texts, and texts that a side doesn't give back byte by byte, have no tokens: zeros and an empty digest.
    Rows with null or repeated ids and repeated rows are aligned and counted each.  Very long texts are aligned
    whole.  Of pairs that tie for a second id's highest count all are best.  An empty table gives an empty result; other columns are ignored.
    """
    rows = written(linked(docs, doc_id, text, first, second).withColumn("row", F.monotonically_increasing_id()))
    counts = written(pair_counts(rows))
    least, known = frequent(counts, limit)
    share = rows.sparkSession.sparkContext.broadcast(known)

    def run(source):
        pair, n, best = share.value
        for batch in source:
            pairs, offsets = _flat(batch.column(1))
            times = _flat(batch.column(2))[0].astype(np.int64)
            at = np.minimum(np.searchsorted(pair, pairs), max(0, len(pair) - 1))
            held = pair[at] == pairs if len(pair) else np.zeros(len(pairs), bool)
            at = at[held]
            doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            sums = []
            for worth in (best, n):
                links = np.zeros(len(pairs) + 1, np.int64)
                links[1:][held] = times[held] * worth[at]
                upto = np.cumsum(links)[offsets]
                sums.append(upto[1:] - upto[:-1])
            left = np.concatenate([[0], np.cumsum(np.bincount(doc[~held], minlength=batch.num_rows))]).astype(np.int32)
            rest = pa.StructArray.from_arrays([pa.array(pairs[~held]), pa.array(times[~held])], ["pair", "times"])
            yield pa.record_batch([batch.column(0), *(pa.array(x) for x in sums), pa.ListArray.from_arrays(pa.array(left), rest)], ["row", "n_best", "count_sum", "rest"])

    some = rows.select("row", "pairs", "times").mapInArrow(run, "row long, n_best long, count_sum long, rest array<struct<pair: int, times: long>>")
    some = written(some)
    rare = counts.filter(F.length(F.bin("n")) < least)
    other = some.filter(F.size("rest") > 0).select("row", F.inline("rest")).join(rare, "pair")
    other = other.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    sums = some.drop("rest").join(other, "row", "left").select("row", *[(F.col(a) + F.coalesce(b, F.lit(0))).cast("long").alias(a) for a, b in (("n_best", "more_best"), ("count_sum", "more_sum"))])
    return rows.drop("pairs", "times").join(sums, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

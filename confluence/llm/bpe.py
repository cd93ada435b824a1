"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Merges of one pre-token wait in buckets, one per merge rank, that hold positions of a linked
list.  A two-level bitmap (words of 256 ranks, and which of those have any) says which buckets
have entries; find-first-set on both gives the next rank.  An entry whose pair has changed meanwhile is stale and skipped.  A pre-token of n bytes
costs O(n), so very long ones are no special case.

Ids of short runs between spaces are kept in bounded caches.
"""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluence.llm.words import batches

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Entries of a cache, and the longest string that one holds.
CACHE, CACHED = 1_000_000, 48
_BIT = [1 << i for i in range(1024)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a .tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Irregular(Exception):
    """White space that the quick split doesn't cover."""


class _Runs(dict):
    """Ids of a run without spaces, led by ``lead``."""

    def __init__(self, codec: Codec, lead: str):
        self.codec, self.lead = codec, lead

    def __missing__(self, run: str) -> tuple[int, ...]:
        if not run or run[-1].isspace() or (not self.lead and run[0].isspace()):
            raise Irregular
        # the usual pattern takes letters, and signs behind them, as one piece each
        if self.codec.newline is not None and run.isalpha():
            pieces = [self.lead + run]
        elif self.codec.newline is not None and run[-1] in ",.;:!?" and run[:-1].isalpha():
            pieces = [self.lead + run[:-1], run[-1]]
        else:
            pieces = self.codec.pattern.findall(self.lead + run)
        if len(pieces) == 1:
            return self.kept(run, self.codec.merged(pieces[0].encode()))
        return self.kept(run, tuple(chain.from_iterable(map(self.codec.piece, pieces))))

    def kept(self, run: str, ids: tuple[int, ...]) -> tuple[int, ...]:
        if len(run) <= CACHED:
            if len(self) >= CACHE:
                self.clear()
            self[run] = ids
        return ids


class Codec:
    """Encodes texts to ids and decodes ids to bytes with the ranks of a vocabulary file."""

    def __init__(self, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN):
        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        # the queue's lower level, empty between pre-tokens: bits of ranks by 256
        self.low = [0] * ((max(self.tokens) >> 8) + 1)
        self.single = [self.ranks[bytes([a])] for a in range(256)]
        self.double = [self.ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]
        self.spaced, self.bare = _Runs(self, " "), _Runs(self, "")
        self.newline = self.ranks.get(b"\n") if pattern == public_tokenizers.PATTERN else None

    def piece(self, text: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        cache, name = (self.spaced, text[1:]) if text[0] == " " else (self.bare, text)
        ids = cache.get(name)
        if ids is None:
            ids = cache.kept(name, self.merged(text.encode())) if name and not name[-1].isspace() else self.merged(text.encode())
        return ids

    def merged(self, data: bytes) -> tuple[int, ...]:
        find = self.ranks.get
        known = find(data)
        if known is not None:
            return (known,)
        n, low, double = len(data), self.low, self.double
        top, buckets = 0, {}
        # rank of the token at a position with the next one; a merged token's id is its merge's rank
        pair = [double[a << 8 | b] for a, b in zip(data, data[1:])]
        pair.append(-1)
        token, end, before = [self.single[a] for a in data], list(range(1, n + 1)), list(range(-1, n - 1))
        fresh = zip(pair, range(n))
        while True:
            for rank, i in fresh:
                if rank >= 0 and pair[i] == rank:
                    if rank in buckets:
                        buckets[rank].append(i)
                    else:
                        buckets[rank] = [i]
                        word = rank >> 8
                        low[word] |= _BIT[rank & 255]
                        top |= _BIT[word]
            if not top:
                break
            word = (top & -top).bit_length() - 1  # find-first-set, level by level
            bits = low[word]
            now = (word << 8) + (bits & -bits).bit_length() - 1
            low[word] = bits = bits & (bits - 1)
            if not bits:
                top &= top - 1
            waiting = buckets.pop(now)
            fresh = []
            if len(waiting) > 1:
                waiting.sort()
            for place, i in enumerate(waiting):
                if pair[i] != now:
                    continue  # stale
                token[i] = now
                j = end[i]
                stop = end[i] = end[j]
                pair[j] = -1
                least = now + 1
                if stop < n:
                    before[stop] = i
                    rank = pair[i] = find(data[i : end[stop]], -1)
                    if rank >= 0:
                        fresh.append((rank, i))
                        least = rank
                else:
                    pair[i] = -1
                p = before[i]
                if p >= 0:
                    rank = pair[p] = find(data[p:stop], -1)
                    if rank >= 0:
                        fresh.append((rank, p))
                        if rank < least:
                            least = rank
                if least <= now:  # only where a vocabulary isn't in the order of its merges
                    fresh += [(now, later) for later in waiting[place + 1 :] if pair[later] == now]
                    break
        out, i = [], 0
        while i < n:
            out.append(token[i])
            i = end[i]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, each match of the pattern by itself.

        White space never follows anything else within a match, so a text can be cut before a
        space or line feed that follows neither; other texts go through the pattern whole.
        """
        if not text:
            return []
        if self.newline is not None:
            try:
                spaced, bare, out = self.spaced.__getitem__, self.bare, []
                for line in text.split("\n"):
                    runs = line.split(" ")
                    out.extend(bare[runs[0]])
                    out.extend(chain.from_iterable(map(spaced, runs[1:])))
                    out.append(self.newline)
                out.pop()
                return out
            except Irregular:
                pass
        return list(chain.from_iterable(map(self.piece, self.pattern.findall(text))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """A codec of this Python worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encoded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids) of each row.  Null and empty texts have no ids; null and repeated ids stay as they are."""

    def run(source):
        own = codec(path, pattern)
        for batch in batches(source, 2 << 20):
            lists = [own.encode(t or "") for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            flat = np.fromiter(chain.from_iterable(lists), np.int32, int(offsets[-1]))
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], ["doc_id", "ids"])

    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, ids array<int>")


def decoded(coded: DataFrame, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids, data): the bytes that each row's ids stand for (null ids: none)."""

    def run(source):
        own = codec(path, pattern)
        for batch in source:
            lists, at = batch.column("ids"), 0
            while at < batch.num_rows:  # a few rows at a time, as texts can be long
                part = lists.slice(at, 64)
                data = [own.decode(x or ()) for x in part.to_pylist()]
                yield pa.record_batch([batch.column("doc_id").slice(at, 64), part, pa.array(data, pa.binary())], ["doc_id", "ids", "data"])
                at += 64

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, data binary")


def coded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids, data): each row encoded, and its ids decoded again, by one worker."""

    def run(source):
        own = codec(path, pattern)
        for batch in batches(source, 2 << 20):
            lists = [own.encode(t or "") for t in batch.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            flat = np.fromiter(chain.from_iterable(lists), np.int32, int(offsets[-1]))
            data = pa.array([own.decode(x) for x in lists], pa.binary())
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)), data], ["doc_id", "ids", "data"])

    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, ids array<int>, data binary")


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row.

    A null text is an empty one: no ids, and the digests of nothing.  Rows with null or repeated ids and repeated
    rows are coded each; very long texts and pre-tokens are coded whole; an empty table gives an empty result;
    other columns are ignored.
    """
    return coded(docs).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("data"), 256).alias("decoded_sha256"),
    )

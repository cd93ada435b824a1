"""Words of whole Arrow batches, as numpy arrays.

A word is a run of bytes outside ``\\x20`` and ``\\x09-\\x0D``, or outside another set of ASCII bytes; A-Z count
as a-z if asked.  Everything works on the batch's one UTF-8 buffer, so a very long text
costs no more per character than a short one.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
#: Longer ranges of bytes are hashed one by one with BLAKE2.
_LONG = 512
#: Masks for the last 0 to 8 bytes of a block.
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The bytes between words of letters, digits and non-ASCII signs.
SIGNS = np.zeros(256, bool)
SIGNS[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets into them; nulls are empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a batch: ``start`` and ``end`` bytes, ``doc`` row, ``hash`` (64 bits).

    ``first[d]`` to ``first[d + 1]`` are the words of row d.
    """

    def __init__(self, texts: pa.Array, lower: bool = True, hashes: bool = True, between: np.ndarray = _SPACE):
        raw, self.offsets = utf8(texts)
        self.raw = raw
        self.data = _LOWER[raw] if lower else raw
        n = len(raw)
        solid = np.empty(n + 2, bool)
        solid[0] = solid[-1] = False
        np.logical_not(between[raw], out=solid[1:-1])
        turn = solid[1:] != solid[:-1]
        # a text's end also ends a word: look at each boundary between two texts
        inner = self.offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        cut = np.unique(inner[solid[inner] & solid[inner + 1]]) if n else inner
        edges = np.flatnonzero(turn)
        if len(cut):
            edges = np.sort(np.concatenate([edges, cut, cut]), kind="stable")
        self.start, self.end = edges[0::2], edges[1::2]
        self.first = np.searchsorted(self.start, self.offsets, "left")
        self.n_docs = len(self.offsets) - 1
        self.n_words = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.n_words)
        if hashes:
            self.hash = self.hashed(self.start, self.end)

    def hashed(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges; equal bytes give equal hashes in any batch.

        Blocks of eight bytes are chained through ``mix``, so ranges of one length up to eight bytes never
        collide, and texts built to break polynomial hashes (Thue-Morse) are as good as any other.
        """
        if not hasattr(self, "_blocks"):
            padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
            self._blocks = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))
        length = end - start
        with np.errstate(over="ignore"):
            out = mix(length.astype(np.uint64) * _M2 + _P)
            at = np.flatnonzero((length > 0) & (length <= _LONG))
            place, left = start[at], length[at]
            while len(at):
                block = self._blocks[place] & _MASK[np.minimum(left, 8)]
                out[at] = mix((out[at] ^ block) + _P)
                more = left > 8
                at, place, left = at[more], place[more] + 8, left[more] - 8
        for i in np.flatnonzero(length > _LONG):
            out[i] = int.from_bytes(blake2b(self.data[start[i] : end[i]], digest_size=8).digest(), "little")
        return out

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(doc, hash) of every run of k words; a shorter text gives its whole run once."""
        return shingles(self.hash, self.first, k)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    n_words = np.diff(first)
    count = np.where(n_words >= k, n_words - k + 1, 0)
    doc = np.repeat(np.arange(len(n_words)), count)
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + first[:-1][doc]
    got = _run(hashes, at, k)
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for size in range(1, k):
            own = n_words[short] == size
            extra[own] = _run(hashes, first[short[own]], size)
        doc, got = np.concatenate([doc, short]), np.concatenate([got, extra])
        order = np.argsort(doc, kind="stable")
        doc, got = doc[order], got[order]
    return doc, got


def _run(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """One hash for the k words from each position on; the order counts."""
    with np.errstate(over="ignore"):
        total = np.full(len(at), np.uint64(k), np.uint64)
        for i in range(k):
            total = mix(total * _P + hashes[at + i])
    return total


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each position on, across texts too."""
    n = max(0, len(hashes) - k + 1)
    with np.errstate(over="ignore"):
        total = np.full(n, np.uint64(k), np.uint64)
        for i in range(k):
            total = mix(total * _P + hashes[i : i + n])
    return total


def distinct(doc: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (doc, value) pairs, sorted by doc and value; ``doc`` must ascend."""
    if not len(doc):
        return doc, values
    values = values.copy()
    edges = np.flatnonzero(doc[1:] != doc[:-1]) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(doc)]):
        values[a:b].sort()
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    return doc[keep], values[keep]


def code_points(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Code points of each text."""
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def batches(source, limit: int = 8 << 20):
    """Record batches cut so that a piece holds about ``limit`` bytes of text (column 1)."""
    for batch in source:
        if not batch.num_rows:
            continue
        length = np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)).astype(np.int64)
        at = np.cumsum(length) // limit
        cuts = np.flatnonzero(np.diff(at)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield batch.slice(int(a), int(b - a))

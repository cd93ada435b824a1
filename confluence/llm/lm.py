"""LM scoring: an interpolated modified Kneser-Ney bigram model.

Counted in Spark: tasks count their words, then their word pairs, and send sorted counts to shards
by ranges of a uniform 64-bit key, so a frequent word or pair is no hot spot; what a task holds is
already summed.  A shard adds up what it gets and writes it as a sorted hash array to the shared
folder.  Workers map those files into memory and look up a batch's distinct pairs by binary search.
"""

from __future__ import annotations

import os
import tempfile
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluence.llm.common import crc_mod5, shared_dir, written
from confluence.llm.words import _M1, _M2, Words, batches, mix

#: Hashes of the end token and of the context before the first word.
END, BEGIN = np.uint64(0x6A09E667F3BCC908), np.uint64(0xBB67AE8584CAA73B)
#: Keys of one shard, about; a task's counts are sent on when it has so many.
SHARD, HELD = 1 << 21, 1 << 22
_I1, _I2 = np.uint64(pow(int(_M1), -1, 1 << 64)), np.uint64(pow(int(_M2), -1, 1 << 64))


def unmixed(x: np.ndarray) -> np.ndarray:
    """The inverse of ``mix``."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))) * _I2
        x = (x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))) * _I1
        return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def counted(keys: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, sorted, and the sums of each column."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    turn = np.ones(len(keys), bool)
    turn[1:] = keys[1:] != keys[:-1]
    begin = np.flatnonzero(turn)
    return [keys[begin], *(np.add.reduceat(c[order], begin) if len(begin) else c[:0] for c in columns)]


def _planes(x: np.ndarray) -> bytes:
    """Differences by byte plane: sorted or small numbers leave few bytes."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _from_planes(data: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(flat.T).reshape(-1).view(np.uint64)


def sent(keys: np.ndarray, columns: list[np.ndarray], bits: int):
    """A batch of (shard, keys, columns...) with a row for each shard that gets some of the sorted keys."""
    shard = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
    cut = np.flatnonzero(np.diff(shard)) + 1
    edges = list(zip([0, *cut.tolist()], [*cut.tolist(), len(keys)])) if len(keys) else []
    rows = [[int(shard[a]) for a, _ in edges], [_planes(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in edges]]
    for column in columns:
        rows.append([_planes(column[a:b].astype(np.uint64)) for a, b in edges])
    names = ["shard", "keys", *(f"c{i}" for i in range(len(columns)))]
    return pa.record_batch([pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])], names)


def summed(source):
    """(shard, [keys, columns...]) of each shard, whose rows come together."""
    name, parts = None, []
    for batch in source:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != name and parts:
                yield name, _joined(parts)
                parts = []
            name = row[0]
            with np.errstate(over="ignore"):
                parts.append([np.cumsum(_from_planes(row[1])), *map(_from_planes, row[2:])])
            if sum(len(p[0]) for p in parts[1:]) > 2 * SHARD:
                parts = [_joined(parts)]
    if parts:
        yield name, _joined(parts)


def _joined(parts):
    return counted(*(np.concatenate(c) for c in zip(*parts)))


# ------------------------------------------------------------------ files that all tasks share


def put(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """Writes arrays behind each other; a second writer of the same name changes nothing."""
    data = b"".join(a.tobytes() for a in arrays)
    if urlparse(folder).scheme in ("", "file"):
        path = urlparse(folder).path
        os.makedirs(path, exist_ok=True)
        part = f"{path}/.{name}.{os.getpid()}"
        with open(part, "wb") as out:
            out.write(data)
        os.replace(part, f"{path}/{name}")
    else:
        store, path = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(path)
        with store.open_output_stream(f"{path}/{name}") as out:
            out.write(data)


def mapped(folder: str, name: str, n: int, kinds: list) -> list[np.ndarray]:
    """The arrays of a file, memory-mapped; from a store that can't be mapped, by way of a local copy."""
    if n == 0:
        return [np.zeros(0, k) for k in kinds]
    path = f"{urlparse(folder).path}/{name}"
    if urlparse(folder).scheme not in ("", "file"):
        store, place = pa.fs.FileSystem.from_uri(folder)
        with tempfile.NamedTemporaryFile(delete=False) as copy, store.open_input_stream(f"{place}/{name}") as data:
            while chunk := data.read(1 << 20):
                copy.write(chunk)
        path = copy.name
    whole, out, at = np.memmap(path, np.uint8, "r"), [], 0
    if urlparse(folder).scheme not in ("", "file"):
        os.unlink(path)  # the mapping holds it; its space is free once the worker ends
    for kind in kinds:
        size = n * np.dtype(kind).itemsize
        out.append(whole[at : at + size].view(kind))
        at += size
    return out


class Sorted:
    """Shards of a sorted hash array."""

    def __init__(self, folder: str, name: str, bits: int, sizes: dict[int, int], kinds: list):
        self.at, self.bits = (folder, name, kinds), bits
        self.sizes, self.shards = sizes, {}
        self.base, total = {}, 0
        for shard in sorted(sizes):
            self.base[shard] = total
            total += sizes[shard]

    def _shard(self, shard: int) -> list[np.ndarray]:
        if shard not in self.shards:
            folder, name, kinds = self.at
            self.shards[shard] = mapped(folder, f"{name}-{shard}", self.sizes[shard], kinds)
        return self.shards[shard]

    def find(self, keys: np.ndarray, *columns: int) -> list[np.ndarray]:
        """For sorted keys: their index (-1: absent) and the columns' values (0 where absent)."""
        index = np.full(len(keys), -1)
        out = [np.zeros(len(keys), np.int64) for _ in columns]
        shard = (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        cut = np.flatnonzero(np.diff(shard)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)]):
            if a == b or int(shard[a]) not in self.sizes:
                continue
            held = self._shard(int(shard[a]))
            at = np.searchsorted(held[0], keys[a:b])
            at[at == len(held[0])] = 0
            ok = held[0][at] == keys[a:b]
            index[a:b][ok] = at[ok] + self.base[int(shard[a])]
            for values, c in zip(out, columns):
                values[a:b][ok] = held[c][at[ok]]
        return [index, *out]


# ------------------------------------------------------------------ tokens


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first): each text's words and one END behind them."""
    words = Words(texts)
    n = words.n_docs
    size = words.n_words + 1
    first = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(first[-1]), np.uint64)
    out[first[1:] - 1] = END
    place = np.ones(len(out), bool)
    place[first[1:] - 1] = False
    out[place] = words.hash
    return out, np.repeat(np.arange(n), size), first


def pair_keys(index: np.ndarray, first: np.ndarray, begin: int) -> np.ndarray:
    """A key for each token with the one before it: ``mix`` of two 32-bit word numbers."""
    before = np.empty_like(index)
    before[1:] = index[:-1]
    before[first[:-1]] = begin
    return mix((before.astype(np.uint64) << np.uint64(32)) | index.astype(np.uint64))


@dataclass
class Model:
    """Where the arrays are, and the numbers of the whole corpus."""

    folder: str
    word_bits: int
    word_sizes: dict[int, int]
    pair_bits: int
    pair_sizes: dict[int, int]
    n_tokens: int
    n_words: int
    begin: int
    discounts: tuple[float, float, float]
    lower_discounts: tuple[float, float, float]
    pair_types: int
    lower_left: float

    def words(self) -> Sorted:
        return Sorted(self.folder, "words", self.word_bits, self.word_sizes, [np.uint64, np.int64])

    def facts(self) -> Sorted:
        return Sorted(self.folder, "facts", self.word_bits, self.word_sizes, [np.uint64, *[np.int64] * 6])

    def pairs(self) -> Sorted:
        return Sorted(self.folder, "pairs", self.pair_bits, self.pair_sizes, [np.uint64, np.int64])


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from counts of counts; 0.5, 1, 1.5 where those don't say."""
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k) for d, k in zip(raw, (0.95, 1.95, 2.95)))


def _bits(n: int) -> int:
    return max(0, (max(1, n) - 1) // SHARD).bit_length()


def _cut(values: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(values, 5), minlength=6)[1:5]


def trained(docs: DataFrame) -> Model:
    """Counts the words and pairs of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    rough = docs.agg(F.sum(F.length("text")), F.count("*")).first()
    word_bits = _bits(((rough[0] or 0) // 24 + rough[1]) // 2)

    def words(source):
        parts, counts, held, begun = [], [], 0, False

        def flush():
            return sent(*(lambda k, c: (k, [c], word_bits))(*counted(np.concatenate(parts), np.concatenate(counts))))

        for batch in batches(source):
            value, n = np.unique(tokens(batch.column(1))[0], return_counts=True)
            if not begun:  # a number for the context before the first word, wherever there is a text
                parts, counts, begun = [np.array([BEGIN])], [np.zeros(1, np.int64)], True
            parts.append(value)
            counts.append(n)
            held += len(value)
            if held > HELD:
                yield flush()
                parts, counts, held = [], [], 0
        if parts:
            yield flush()

    def keep_words(source):
        for shard, (keys, n) in summed(source):
            put(folder, f"words-{shard}", [keys, n.astype(np.int64)])
            yield pa.record_batch([pa.array([x]) for x in (shard, len(keys), int(n.sum()), int((n > 0).sum()))], ["shard", "n", "total", "seen"])

    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_shard = lambda df, bits: df.repartition(max(least, 1 << bits), "shard").sortWithinPartitions("shard")
    got = by_shard(docs.mapInArrow(words, "shard int, keys binary, c0 binary"), word_bits).mapInArrow(keep_words, "shard long, n long, total long, seen long").collect()
    model = Model(folder, word_bits, {r.shard: r.n for r in got}, 0, {}, sum(r.total for r in got), sum(r.seen for r in got), 0, (), (), 0, 0.0)
    if not got:
        model.lower_left = 1.0
        model.discounts = model.lower_discounts = discounts(0, 0, 0, 0)
        return model
    if sum(model.word_sizes.values()) >> 32:
        raise OverflowError("a pair's key holds two word numbers of 32 bits: the corpus has more distinct words")
    pair_bits = model.pair_bits = _bits(model.n_tokens // 2)
    store = model.words()
    model.begin = int(store.find(np.array([BEGIN]))[0][0])
    base, begin = dict(store.base), model.begin

    def pairs(source):
        table, parts, counts, held = model.words(), [], [], 0
        for batch in batches(source):
            value, _, first = tokens(batch.column(1))
            name, at = np.unique(value, return_inverse=True)
            key, n = np.unique(pair_keys(table.find(name)[0][at], first, begin), return_counts=True)
            parts.append(key)
            counts.append(n)
            held += len(key)
            if held > HELD:
                key, n = counted(np.concatenate(parts), np.concatenate(counts))
                yield sent(key, [n], pair_bits)
                parts, counts, held = [], [], 0
        if parts:
            key, n = counted(np.concatenate(parts), np.concatenate(counts))
            yield sent(key, [n], pair_bits)

    # a word's facts go to its word shard: numbers are scaled so that their high bits are the shard's
    starts = np.array([base[s] for s in sorted(base)])
    shards = np.array(sorted(base))

    def placed(number: np.ndarray) -> np.ndarray:
        at = np.searchsorted(starts, number, "right") - 1
        high = shards[at].astype(np.uint64) << np.uint64(64 - word_bits) if word_bits else np.uint64(0)
        return high + (number - starts[at]).astype(np.uint64)

    def keep_pairs(source):
        for shard, (keys, n) in summed(source):
            put(folder, f"pairs-{shard}", [keys, n.astype(np.int64)])
            both = unmixed(keys)
            before, word = (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
            n = n.astype(np.int64)
            zero = np.zeros(len(n), np.int64)
            facts = counted(np.concatenate([before, word]), *(np.concatenate([x, zero]) for x in (n, n == 1, n == 2, n > 2)), np.concatenate([zero, zero + 1]))
            out = sent(placed(facts[0]), facts[1:], word_bits)
            few = _cut(n)
            names = ["shard", "keys", "c0", "c1", "c2", "c3", "c4"]
            yield pa.record_batch([pa.array([None] * out.num_rows, pa.int32()), *(pa.array([None] * out.num_rows, pa.int64()) for _ in range(5)), *(out.column(c) for c in names)], ["pairs", "n", "n1", "n2", "n3", "n4", *names])
            yield pa.record_batch([pa.array([shard], pa.int32()), *(pa.array([int(x)]) for x in (len(keys), *few)), pa.array([None], pa.int32()), *(pa.array([None], pa.binary()) for _ in names[1:])], ["pairs", "n", "n1", "n2", "n3", "n4", *names])

    blobs = ", ".join(f"c{i} binary" for i in range(5))
    both = written(by_shard(docs.mapInArrow(pairs, "shard int, keys binary, c0 binary"), pair_bits).mapInArrow(keep_pairs, f"pairs int, n long, n1 long, n2 long, n3 long, n4 long, shard int, keys binary, {blobs}"))
    got = both.filter("pairs is not null").select("pairs", "n", "n1", "n2", "n3", "n4").collect()
    model.pair_sizes = {r.pairs: r.n for r in got}
    model.discounts = discounts(*(sum(r[f"n{i}"] for r in got) for i in range(1, 5)))

    def keep_facts(source):
        for shard, (keys, total, n1, n2, n3, preceding) in summed(source):
            size = model.word_sizes[shard]
            at = (keys & np.uint64((1 << (64 - word_bits)) - 1)).astype(np.int64) if word_bits else keys.astype(np.int64)
            dense = []
            for column in (total, n1, n2, n3, preceding):
                full = np.zeros(size, np.int64)
                full[at] = column
                dense.append(full)
            held = mapped(folder, f"words-{shard}", size, [np.uint64, np.int64])
            put(folder, f"facts-{shard}", [*held, *dense])
            few, cont = _cut(dense[-1][dense[-1] > 0]), dense[-1]
            yield pa.record_batch([pa.array([int(x)]) for x in (shard, *few, (cont > 2).sum(), cont.sum())], ["shard", "t1", "t2", "t3", "t4", "many", "types"])

    facts = by_shard(both.filter("pairs is null").select("shard", "keys", *(f"c{i}" for i in range(5))), word_bits)
    got = facts.mapInArrow(keep_facts, "shard long, t1 long, t2 long, t3 long, t4 long, many long, types long").collect()
    add = lambda c: sum(r[c] for r in got)
    d = model.lower_discounts = discounts(*(add(f"t{i}") for i in range(1, 5)))
    model.pair_types = add("types")
    model.lower_left = (d[0] * add("t1") + d[1] * add("t2") + d[2] * add("many")) / max(1, model.pair_types)
    return model


def _less(values: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(values - np.array([0.0, *d])[np.minimum(values, 3)], 0)


def logs(model: Model, texts: pa.Array, facts: Sorted, pairs: Sorted) -> dict[str, np.ndarray]:
    """The measures of each text."""
    value, _, first = tokens(texts)
    name, at = np.unique(value, return_inverse=True)
    index, count, total, n1, n2, n3, preceding = (x[at] for x in facts.find(name, 1, 2, 3, 4, 5, 6))
    seen = count > 0
    base = np.log10((count + 0.5) / (model.n_tokens + 0.5 * (model.n_words + 1)))
    lower = _less(preceding, model.lower_discounts) / max(1, model.pair_types) + model.lower_left / (model.n_words + 1)
    known = index >= 0
    key = pair_keys(np.where(known, index, 0), first, model.begin)
    before = np.empty_like(index)
    before[1:] = index[:-1]
    before[first[:-1]] = model.begin
    facts_before = [np.concatenate([[0], x[:-1]]) for x in (total, n1, n2, n3)]
    start = facts.find(np.array([BEGIN]), 2, 3, 4, 5)[1:]
    for column, own in zip(facts_before, start):
        column[first[:-1]] = own[0]
    total, n1, n2, n3 = facts_before
    asked, back = np.unique(key, return_inverse=True)
    together = np.where(known & (before >= 0), pairs.find(asked, 1)[1][back], 0)
    d, mass = model.discounts, np.maximum(total, 1)
    chance = np.where(total > 0, _less(together, d) / mass + (d[0] * n1 + d[1] * n2 + d[2] * n3) / mass * lower, lower)
    add = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  every text has its end token
    return {"n_tokens": np.diff(first), "n_known": add(seen.astype(np.int64)), "base_score": add(base), "score": add(np.log10(chance))}


_OPEN: dict[str, tuple[Sorted, Sorted]] = {}


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs`` (doc_id, text)."""

    def run(source):
        if model.folder not in _OPEN:
            _OPEN.clear()
            _OPEN[model.folder] = model.facts(), model.pairs()
        for batch in batches(source):
            got = logs(model, batch.column(1), *_OPEN[model.folder])
            yield pa.record_batch({"doc_id": batch.column(0), **{k: pa.array(v) for k, v in got.items()}, "train_tokens": pa.array(np.full(batch.num_rows, model.n_tokens))})

    out = docs.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double, train_tokens long")
    return out.select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row.

    The model learns from rows whose crc32(doc_id as text) mod 5 isn't 1 (a null id counts as empty text).
    Null and empty texts are one end token.  Repeated rows count and are scored each.  Without any
    training row the scores are those of the uniform distribution over the unknown word; an empty table
    gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    model = trained(docs.filter(crc_mod5() != 1))
    return scored(docs, model).select("doc_id", (crc_mod5() == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

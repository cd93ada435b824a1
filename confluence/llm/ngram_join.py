"""N-gram Jaccard join: exact self-join of the shingle sets of whole texts, as linked components.

Method: universe-partition pigeonhole.  Sizes fall into geometric bands.  A band with
largest size U bounds the Hamming distance of a linked pair by H = floor(2U(100-p)/(100+p)).
The hash universe is cut into segments of total weight H + 1 + slack: an exact segment
(weight 1) is missed only by a difference in it, a deletion segment (weight 2) only by two
differences, as each side also indexes its one-deletion neighbourhood.  So matching segments
of weight slack + 1 remain for every linked pair.  How many of each kind a band uses, and its
slack, comes from a cost model (``allocation``).  Empty segments are never indexed: a set
whose empty ones weigh more than the slack ("thin") is hashed anew for pairs of thin sets,
and the last seed indexes the empty segments too, so no pair can be lost.

Every set also knows how many segments it must share with any partner ("need"): the segments of its
band, less the largest distance that its own size allows, less its empty segments.  A set that meets
others in fewer keys has no partner, so passages that many texts share cost little.

Keys travel packed, one block a chunk of texts and a shard of the keys; of a key that a chunk holds
several times only the first goes on, so a key's group grows with the chunks and not with the rows.
Groups are first stars: each member against the group's first.  Pairs in one component need no look.
Sets in groups that still span components go through an exact prefix filter (rarest shingles first)
and a parity-bitmap bound before they are verified: first a few partners of each, which joins what is alike,
then all pairs of what is still apart.  Verification intersects the sets of the whole texts.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluence.llm.common import Scratch, id_set_bits, written
from confluence.llm.words import Words, batches, distinct, mix

SEEDS = 4
#: Buckets of the sketch that orders shingles by frequency (its size is fixed).
SKETCH_BITS = 18
#: Keys of one packed chunk, and shingles to a shard of the keys, about.
CHUNK, SHARD = 1 << 20, 1 << 21
#: A key is heavy if it holds over this part of all rows.
HEAVY = 1000
#: Partners of a row in a block that are verified before all of them.
FEW = 3
#: Rows that one comparison block has from each of its two sides.
BLOCK = 512


@dataclass(frozen=True)
class Band:
    """Sizes low..top; ``exact`` + 2 * ``deletion`` = ``distance`` + 1 + ``slack``."""

    low: int
    top: int
    distance: int
    exact: int
    deletion: int
    slack: int


def _poisson(mean: float, most: int) -> list[float]:
    """Chances of 0 .. most."""
    out = [math.exp(-mean)]
    for i in range(1, min(most, 900) + 1):
        out.append(out[-1] * mean / i)
    return out


def _thin(exact: float, deletion: float, slack: int) -> float:
    """Chance that empty segments weigh more than the slack (Poisson occupancy)."""
    one, two = _poisson(exact, slack), _poisson(deletion, slack // 2)
    return max(0.0, 1 - sum(two[d] * sum(one[: slack - 2 * d + 1]) for d in range(len(two))))


def allocation(low: int, top: int, distance: int, percent: int) -> Band:
    """The cheapest segments for a band: keys indexed, weak keys of one shingle, and thin sets.

    Half of the sets are thought to be of the band, half smaller ones that may link into it.
    """
    if distance > 20_000:  # a spare 64th is far more than the empty segments of so many
        return Band(low, top, distance, distance + 1 + distance // 64, 0, distance // 64)
    best, at = None, math.inf
    for spare in sorted({*range(9), *(distance // part for part in (100, 80, 64, 48, 40, 32, 24, 20, 16, 12, 10, 8))}):
        weight = distance + 1 + spare
        for deletion in {0, weight // 4, weight // 2, (weight + 1) // 2} if distance < 100 else {0}:
            exact = max(0, weight - 2 * deletion)
            units, cost = exact + 2 * deletion, 0.0
            slack = units - distance - 1
            spared = distance - (low - 1 + top) * (100 - percent) // (100 + percent)
            for mean, room in ((math.sqrt(low * top), slack), (low * math.sqrt(percent / 100), slack + spared)):
                load = mean / units
                keys = exact * (1 - math.exp(-load)) + deletion * (1 + 2 * load)
                weak = exact * load * math.exp(-load) + deletion * (2 * load) ** 2 * math.exp(-2 * load)
                thin = _thin(exact * math.exp(-load), deletion * math.exp(-2 * load) * (1 + 2 * load), room)
                cost += keys + weak + 2 * thin * keys
            if cost < at:
                best, at = Band(low, top, distance, exact, deletion, slack), cost
    return best


def bands(percent: int, ratio: float = 1.35, largest: int = 1 << 40) -> list[Band]:
    out, low = [], 1
    while low <= largest:
        top = max(low, math.ceil(low * max(ratio, 100 / percent)) - 1)
        if not out:  # the first band takes all sizes that only equal sets can match
            while 2 * (top + 1) * (100 - percent) // (100 + percent) == 0:
                top += 1
            while top > 1 and 2 * top * (100 - percent) // (100 + percent) > 0:
                top -= 1
        distance = 2 * top * (100 - percent) // (100 + percent)
        out.append(allocation(low, top, distance, percent) if distance else Band(low, top, 0, 0, 0, 0))
        low = top + 1
    return out


def shingle_sets(batch: pa.RecordBatch, k: int):
    """Sorted distinct shingles of each text: (first, values)."""
    words = Words(batch.column(1))
    doc, values = distinct(*words.shingles(k))
    return np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=batch.num_rows))]), values


def _sums(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums over each text's values, modulo 2**64 (0 for empty ones)."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    with np.errstate(over="ignore"):
        return total[first[1:]] - total[first[:-1]]


def set_names(first: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each set; both are equal only for equal sets."""
    return _sums(first, mix(values)), _sums(first, mix(values ^ np.uint64(0xD1B54A32D192ED03)))


def keys_of(first: np.ndarray, values: np.ndarray, plan: list[Band], percent: int, seed: int = 0, roles: np.ndarray | None = None):
    """(row, key, need) of every indexed segment, and which sets are thin under this seed, [row, role].

    A set has two roles: in its own band, and, if it may link to larger sets, in the next one.
    ``roles`` says which of them to index.  ``need``: so many keys of this role and seed, at least, a set
    shares with any partner, thin ones excepted (1).
    """
    n = np.diff(first)
    roles = np.ones((len(n), 2), bool) if roles is None else roles
    lows = np.array([b.low for b in plan])
    if seed:
        values = mix(values ^ mix(np.full(1, seed, np.uint64)))
        doc = np.repeat(np.arange(len(n)), n)
        _, values = distinct(doc, values)
    own = np.searchsorted(lows, n, "right") - 1
    rows, keys, needs, thin = [], [], [], np.zeros((len(n), 2), bool)
    up = np.minimum(own + 1, len(plan) - 1)
    for role, (band_of, here) in enumerate(((own, n > 0), (up, (n > 0) & (n * 100 >= percent * lows[up]) & (up > own)))):
        exact, deletion, top = (np.array([getattr(b, a) for b in plan])[band_of] for a in ("exact", "deletion", "top"))
        here = np.flatnonzero(here & roles[:, role] & (exact + deletion > 0))
        if not len(here):
            continue
        count = n[here]
        doc = np.repeat(here, count)
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + first[:-1][doc]
        token = values[at]
        unit = ((token >> np.uint64(32)) * (exact + 2 * deletion)[doc].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        e = exact[doc]
        segment = np.where(unit < e, unit, e + (unit - e) // 2)
        turn = np.ones(len(doc), bool)
        turn[1:] = (doc[1:] != doc[:-1]) | (segment[1:] != segment[:-1])
        begin = np.flatnonzero(turn)
        size = np.diff(np.append(begin, len(doc)))
        d, s = doc[begin], segment[begin]
        near = s >= exact[d]
        empty = np.zeros(len(n), np.int64)
        empty[here] = (exact - np.bincount(d[~near], minlength=len(n)))[here] + 2 * (deletion - np.bincount(d[near & (size > 1)], minlength=len(n)))[here]
        # segments that agree with any partner: all but as many as the largest distance that n allows
        share = exact + 2 * deletion - (n + np.minimum(top, 100 * n // percent)) * (100 - percent) // (100 + percent) - empty
        thin[here, role] = share[here] < 1
        need = np.clip(np.where(deletion > 0, (share + 1) // 2, share), 1, 255)
        role_rows = []
        with np.errstate(over="ignore"):
            value = mix(token ^ np.uint64(0xA0761D6478BD642F))
            total = np.add.reduceat(value, begin)
            place = mix(((band_of[d] * SEEDS + seed).astype(np.uint64) << np.uint64(40)) + s.astype(np.uint64))
            role_rows.append(d)
            keys.append(mix(total + place))
            each = np.repeat(near & (size > 1), size)
            group = np.repeat(np.arange(len(begin)), size)[each]
            role_rows.append(d[group])
            keys.append(mix(total[group] - value[each] + place[group]))
        if seed == SEEDS - 1:  # the exact way for the rest: index empty segments as well
            for r in np.flatnonzero(thin[:, role]):
                held = {int(x): int(c) for x, c in zip(s[d == r], size[d == r])}
                lone = [x for x in range(exact[r] + deletion[r]) if held.get(x, 0) <= (x >= exact[r])]
                role_rows.append(np.full(len(lone), r))
                with np.errstate(over="ignore"):
                    place = mix((np.uint64(band_of[r] * SEEDS + seed) << np.uint64(40)) + np.array(lone, np.uint64))
                    keys.append(mix(place))
        role_rows = np.concatenate(role_rows)
        rows.append(role_rows)
        needs.append(need[role_rows].astype(np.uint8))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8), thin
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(needs), thin


def index_keys(first, values, plan, percent):
    """(row, key, need) over all seeds; a later seed takes only sets that were thin under each one before."""
    rows, keys, needs, thin = keys_of(first, values, plan, percent)
    out, names = [(rows, keys, needs)], np.arange(len(thin))
    for seed in range(1, SEEDS):
        chosen = np.flatnonzero(thin.any(axis=1))
        if not len(chosen):
            break
        names, roles = names[chosen], thin[chosen]
        values = np.concatenate([values[first[r] : first[r + 1]] for r in chosen])
        first = np.concatenate([[0], np.cumsum(np.diff(first)[chosen])])
        rows, keys, needs, thin = keys_of(first, values, plan, percent, seed, roles)
        out.append((names[rows], keys, needs))
    return tuple(np.concatenate(x) for x in zip(*out))


def parity_bits(values: np.ndarray) -> bytes:
    """Bitmap of value counts modulo 2; bits that differ between two sets never exceed their distance."""
    n = len(values)  # small sets get bitmaps in which two values hardly ever meet
    width = min(64 << max(0, max(2 * n, min(16 * n, 1024)).bit_length() - 6), 1 << 16)
    bits = np.bincount((mix(values ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def linked_sizes(common, a, b, percent: int):
    """Whether sets of sizes a and b with so many common members link."""
    return (100 + percent) * common >= percent * (a + b)


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


def profiles(docs: DataFrame, k: int) -> DataFrame:
    """(id, n, h1, h2): size and names of each row's shingle set."""

    def run(source):
        for batch in batches(source):
            first, values = shingle_sets(batch, k)
            h1, h2 = set_names(first, values)
            yield pa.record_batch([batch.column(0), pa.array(np.diff(first)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["id", "n", "h1", "h2"])

    return docs.mapInArrow(run, "id long, n long, h1 long, h2 long")


def _grouped(key: np.ndarray, id_: np.ndarray, need: np.ndarray):
    """Rows in order of key and id without repetitions, and of each row its group's begin and size."""
    order = np.lexsort((id_, key))
    key, id_, need = key[order], id_[order], need[order]
    turn = np.ones(len(key), bool)
    turn[1:] = (key[1:] != key[:-1]) | (id_[1:] != id_[:-1])
    key, id_, need = key[turn], id_[turn], need[turn]
    begin = np.ones(len(key), bool)
    begin[1:] = key[1:] != key[:-1]
    begin = np.flatnonzero(begin)
    size = np.diff(np.append(begin, len(key)))
    return key, id_, need, begin, size


def _narrow(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in the narrowest type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max(initial=0))))


def _packed(held: list, shards: int):
    """(shard, whole, blob) rows of a chunk's keys.

    Groups that the chunk holds whole go anywhere (``whole``: their rows are ready); of each key its first id
    goes to the key's shard, with need 0 if its row is among those.  A key is its shard and 40 bits.
    """
    key, id_, need, begin, size = _grouped(*(np.concatenate(x) for x in zip(*held)))
    shard = (key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
    key = key & np.uint64((1 << 40) - 1)
    several = size > 1
    member = np.repeat(several, size)
    if member.any():
        named = (shard << np.uint64(40) | key)[begin[several]]
        ids = id_[member]
        yield int(named[0] % np.uint64(shards)), True, pickle.dumps((named, _narrow(size[several]), ids.min(), _narrow(ids - ids.min()), need[member]), 5)
    shard, key, id_, need = shard[begin], key[begin], id_[begin], np.where(several, 0, need[begin]).astype(np.uint8)
    order = np.lexsort((id_, shard))
    shard, key, id_, need = shard[order], key[order], id_[order], need[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]]) if len(shard) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        low, high = key[a:b].astype(np.uint32), (key[a:b] >> np.uint64(32)).astype(np.uint8)
        yield int(shard[a]), False, pickle.dumps((low, high, int(id_[a]), _narrow(np.diff(id_[a:b])), need[a:b]), 5)


def shared_keys(docs: DataFrame, k: int, percent: int, shards: int) -> DataFrame:
    """(key, id, low, need): the indexed segments that two sets share or more.

    ``low`` is the first id of the row's group, or of its part in a chunk.  A set stands under its first id in a
    chunk of texts.  A row with need 0 repeats one that its chunk's group has.
    """
    plan = bands(percent)

    def chunks(source):
        seen, held, size = set(), [], 0
        for batch in batches(source):
            first, values = shingle_sets(batch, k)
            names = zip(*(x.tolist() for x in set_names(first, values)), np.diff(first).tolist())
            fresh = []
            for r, name in enumerate(names):
                if name[2] and name not in seen:
                    seen.add(name)
                    fresh.append(r)
            if not fresh:
                continue
            values = np.concatenate([values[first[r] : first[r + 1]] for r in fresh])
            first = np.concatenate([[0], np.cumsum(np.diff(first)[fresh])])
            rows, keys, needs = index_keys(first, values, plan, percent)
            held.append((keys, np.asarray(batch.column(0).take(pa.array(fresh)))[rows], needs))
            size += len(keys)
            if size >= CHUNK:
                yield from _packed(held, shards)
                seen, held, size = set(), [], 0
        if size:
            yield from _packed(held, shards)

    def run(source):
        for shard, whole, blob in chunks(source):
            yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([whole]), pa.array([blob], pa.binary())], ["shard", "whole", "blob"])

    def batch_of(key, id_, low, need):
        for at in range(0, len(key), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.record_batch([pa.array(key[part].view(np.int64)), pa.array(id_[part]), pa.array(low[part]), pa.array(need[part].astype(np.int16))], ["key", "id", "low", "need"])

    def met(shard, held):
        if held:
            key, id_, need, begin, size = _grouped(*(np.concatenate(x) for x in zip(*held)))
            several = np.repeat(size > 1, size)
            low = np.repeat(id_[begin], size)
            yield from batch_of((key | np.uint64(shard << 40))[several], id_[several], low[several], need[several])

    def groups(source):
        held, name = [], -1
        for batch in source:
            for shard, whole, blob in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if whole:
                    named, size, base, ids, need = pickle.loads(blob)
                    ids = ids.astype(np.int64) + base
                    size = size.astype(np.int64)
                    yield from batch_of(np.repeat(named, size), ids, np.repeat(ids[np.cumsum(size) - size], size), need)
                    continue
                if shard != name:
                    yield from met(name, held)
                    held, name = [], shard
                low, high, base, steps, need = pickle.loads(blob)
                held.append((high.astype(np.uint64) << np.uint64(32) | low, np.concatenate([[base], base + np.cumsum(steps, dtype=np.int64)]), need))
        yield from met(name, held)

    sent = docs.mapInArrow(run, "shard int, whole boolean, blob binary").repartition(shards, "shard")
    return sent.sortWithinPartitions("shard").mapInArrow(groups, "key long, id long, low long, need short")


def set_table(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, n, bits, text) of the sets that ``ids`` name, and of few others; nothing is shuffled for it."""
    log2_bits = min(26, max(16, (8 * ids.count()).bit_length()))
    kept = np.frombuffer(id_set_bits(ids, "id", log2_bits), np.uint64)
    share = docs.sparkSession.sparkContext.broadcast(kept)
    near = docs.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(len(kept) * 64)))

    def run(source):
        held = share.value
        for batch in source:
            slot = np.asarray(batch.column(2))
            there = (held[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1
            for part in batches([batch.filter(pa.array(there))]):
                first, values = shingle_sets(part, k)
                bits = pa.array([parity_bits(values[a:b]) for a, b in zip(first[:-1], first[1:])], pa.binary())
                yield pa.record_batch([part.column(0), pa.array(np.diff(first)), bits, part.column(1)], ["id", "n", "bits", "text"])

    return near.mapInArrow(run, "id long, n long, bits binary, text string")


def verified(pairs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link; sizes and bitmaps alone refuse most others first."""

    def possible(source):
        for batch in source:
            n, m = (np.asarray(batch.column(c)) for c in ("na", "nb"))
            at = np.flatnonzero(_possible(n, m, percent))
            x, y = (_bitmaps(batch.column(c)) for c in ("x", "y"))
            near = _differing(x, y, at, at) <= (n + m)[at] * (100 - percent) // (100 + percent)
            yield batch.select(["a", "b"]).take(pa.array(at[near]))

    def exact(source):
        for batch in source:
            for part in batches([batch.select(["a", "x", "b", "y"])]):
                ids = [*part.column(0).to_pylist(), *part.column(2).to_pylist()]
                place = {id_: i for i, id_ in enumerate(ids)}
                at = list(place.values())
                texts = pa.concat_arrays([part.column(1), part.column(3)]).take(pa.array(at))
                first, values = shingle_sets(pa.record_batch([pa.array(at), texts], ["id", "text"]), k)
                own = {id_: values[first[i] : first[i + 1]] for i, id_ in enumerate(place)}
                both = ((own[a], own[b]) for a, b in zip(ids[: part.num_rows], ids[part.num_rows :]))
                keep = [linked_sizes(_common(x, y), len(x), len(y), percent) for x, y in both]
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def beside(pairs, column):
        return pairs.join(sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col(column).alias("x")), "a").join(
            sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col(column).alias("y")), "b"
        )

    left = beside(pairs, "bits").select("a", "b", "na", "nb", "x", "y").mapInArrow(possible, "a long, b long")
    return beside(left, "text").select("a", "b", "x", "y").mapInArrow(exact, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that edges (a, b) reach from each id they hold.

    Every round an id takes the least label beside it, its old label's holders follow, and
    labels jump to their own label, so the rounds grow with the logarithm of a path.
    """
    scratch = Scratch(edges.sparkSession)
    both = scratch.written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = scratch.written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        beside = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("other"))
        moved = labels.join(beside, labels["id"] == beside["a"], "left").select("id", "label", F.least("label", "other").alias("low"))
        root = moved.groupBy("label").agg(F.min("low").alias("root"))
        jump = root.select(F.col("label").alias("root"), F.col("root").alias("next"))
        root = root.join(jump, "root", "left").select("label", F.coalesce("next", "root").alias("root"))
        fresh = scratch.written(moved.join(root, "label").select("id", F.least("low", "root").alias("label"), F.col("label").alias("old")))
        if fresh.filter("label <> old").isEmpty():
            found = written(fresh.select("id", F.col("label").alias("component")))
            scratch.clear()
            return found
        labels = fresh.select("id", "label")


def _rarest(sets: DataFrame, k: int) -> np.ndarray:
    """Counts of shingles by bucket, a fixed 2**SKETCH_BITS of them."""

    def run(source):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches(source):
            _, values = shingle_sets(batch, k)
            total += np.bincount((values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    counted = sets.select("id", "text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    out[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    return out


def _bitmaps(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bitmaps of a column as one run of 64-bit words, where each begins, and its words."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), np.uint64), (offsets[:-1] - offsets[0]) // 8, np.diff(offsets) // 8


def _differing(x, y, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ between bitmaps a of x and b of y, the wider one folded (folding keeps parities)."""
    out = np.zeros(len(a), np.int64)
    for wx, wy in np.unique(np.stack([x[2][a], y[2][b]]), axis=1).T.tolist() if len(a) else ():
        own, narrow = np.flatnonzero((x[2][a] == wx) & (y[2][b] == wy)), min(wx, wy)
        step = max(1, (1 << 21) // (wx + wy))
        for at in range(0, len(own), step):
            part = own[at : at + step]
            sides = (words[begin[rows[part]][:, None] + np.arange(wide)].reshape(len(part), -1, narrow) for (words, begin, _), rows, wide in ((x, a, wx), (y, b, wy)))
            left, right = (np.bitwise_xor.reduce(side, axis=1) for side in sides)
            out[part] = np.bitwise_count(left ^ right).sum(axis=1)
    return out


def _possible(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes n and m can link at all."""
    return np.minimum(n, m) * 100 >= np.maximum(n, m) * percent


def prefix_tokens(own: DataFrame, k: int, percent: int) -> DataFrame:
    """(token, id): each set's rarest shingles, so many that any partner shares one of its own."""
    share = own.sparkSession.sparkContext.broadcast(_rarest(own, k))

    def prefixes(source):
        rank = share.value
        for batch in batches(source):
            first, values = shingle_sets(batch, k)
            rows, tokens = [], []
            for r, (a, b) in enumerate(zip(first[:-1], first[1:])):
                x = values[a:b]
                order = np.lexsort((x, rank[(x >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))
                need = -(-percent * len(x) // 100)  # common members of any partner, at least
                tokens.append(x[order[: len(x) - need + 1]])
                rows.append(np.full(len(tokens[-1]), r))
            yield pa.record_batch([pa.array(np.concatenate(tokens).view(np.int64)), batch.column(0).take(pa.array(np.concatenate(rows)))], ["token", "id"])

    return own.select("id", "text").mapInArrow(prefixes, "token long, id long")


def candidate_pairs(tokens: DataFrame, own: DataFrame, labels: DataFrame, percent: int, most: int | None = None) -> DataFrame:
    """Pairs (a, b) of different components that share a token and that sizes and bitmaps leave.

    ``labels``: (id, component).  A token that many sets hold is dealt into parts, and each two of them are a block.
    With ``most`` each part is a block of its own, other parts for other tokens, and a row brings so many pairs
    only: no row is sent twice, and what is alike gets joined before all pairs are asked for.
    """
    placed = tokens.join(labels, "id")
    several = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("held")).filter("lo <> hi")
    mixed = (
        placed.join(several.select("token", "held"), "token")
        .withColumn("parts", F.ceil(F.col("held") / BLOCK).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64("id", "token"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)) if most is None else F.col("part"))
        .select("token", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "component")
    )
    mixed = mixed.join(own.select("id", "n", "bits"), "id")

    def compared(source):
        rest = None
        for batch in source:
            batch = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks().to_batches()[0]
            name = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("token", "i", "j")])
            turn = np.flatnonzero((name[:, 1:] != name[:, :-1]).any(axis=0)) + 1
            at = int(turn[-1]) if len(turn) else 0  # the last group may go on in the next batch
            rest = batch.slice(at)
            yield from blocks(batch.slice(0, at), np.append(turn, at)[:-1] if at else turn)
        if rest is not None:
            yield from blocks(rest, np.zeros(0, np.int64))

    def blocks(batch, turn):
        """Pairs of groups that begin at 0 and at ``turn``."""
        rows = batch.num_rows
        if rows < 2:
            return
        last = np.repeat(np.append(turn, rows), np.diff(np.concatenate([[0], turn, [rows]])))
        left, right = _followers(last - np.arange(rows) - 1)
        part, ids, component, n = (np.asarray(batch.column(c)) for c in ("part", "id", "component", "n"))
        inner = np.asarray(batch.column("i")) == np.asarray(batch.column("j"))
        ok = (component[left] != component[right]) & (ids[left] != ids[right]) & (inner[left] | (part[left] != part[right])) & _possible(n[left], n[right], percent)
        left, right = left[ok], right[ok]
        bits = _bitmaps(batch.column("bits"))
        near = _differing(bits, bits, left, right) <= (n[left] + n[right]) * (100 - percent) // (100 + percent)
        left, right = left[near], right[near]
        if most is not None:
            begin = np.searchsorted(left, left)
            first = np.arange(len(left)) - begin < most
            left, right = left[first], right[first]
        a, b = ids[left], ids[right]
        if len(a):
            a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    found = mixed.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(compared, "a long, b long")
    return found.distinct()


def _followers(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, one of the ``count`` rows after it)."""
    left = np.repeat(np.arange(len(count)), count)
    return left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)


def _beside(rows: DataFrame, classes: DataFrame, on: list[str], most: int) -> DataFrame:
    """``rows`` with the columns of ``classes``, whose key is unique and whose ``held`` counts its rows.

    Keys that hold over a HEAVYth of all ``most`` rows, fewer than HEAVY, are broadcast; so no task of the other join
    has more rows of one key.
    """
    heavy = F.col("held") * HEAVY > most
    large, small = (classes.filter(x).drop("held") for x in (heavy, ~heavy))
    return rows.join(F.broadcast(large), on).unionByName(rows.join(F.broadcast(large.select(on)), on, "left_anti").join(small, on))


def linked_components(docs: DataFrame, k: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Words are runs of bytes outside ``\\x20 \\x09-\\x0D`` with A-Z lower-cased; a text with
    fewer than ``k`` words is one shingle.  Two rows link when 100 * common >= percent * union.
    component_id is the smallest doc_id reachable by links, the row's own included.

    Null and empty texts have no shingles and link with nothing.  Rows of equal texts are linked.
    Rows that share a doc_id are one document: a link of any of them is a link of the id, and all get its
    component (for this the table is written once with a row key).  A null doc_id gets a null component and
    links nothing.  An empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    if docs.groupBy("id").count().filter("count > 1 or id is null").isEmpty():
        return _components_of_rows(docs, k, percent).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    own = written(docs.filter("id is not null").select(F.monotonically_increasing_id().alias("row"), "id", "text"))
    rows = written(_components_of_rows(own.select(F.col("row").alias("id"), "text"), k, percent).withColumnRenamed("id", "row").join(own.select("row", "id"), "row"))
    classes = rows.groupBy("component").agg(F.min("id").alias("low"), F.count("*").alias("held"))
    edges = _beside(rows, classes, ["component"], rows.count()).filter("id <> low").select(F.col("low").alias("a"), F.col("id").alias("b")).distinct()
    found = components(edges)
    classes = rows.groupBy("id").agg(F.count("*").alias("held")).join(found, "id", "left").select("id", "held", F.coalesce("component", "id").alias("component_id"))
    placed = _beside(rows.select("id", "n"), classes, ["id"], rows.count())
    lost = profiles(docs.filter("id is null"), k).select("id", "n", F.lit(None).cast("long").alias("component_id"))
    return placed.unionByName(lost).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


def _components_of_rows(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, n, component) of rows (id, text) whose id is a key."""
    scratch = Scratch(docs.sparkSession)
    own = written(profiles(docs, k))
    size = own.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # a set stands under its smallest id
    first_of = written(own.filter("n > 0").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("held")))
    reps = written(_beside(own.filter("n > 0"), first_of, ["h1", "h2", "n"], size[0]).select("id", "n", "rep"))

    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size[1] // SHARD + 1)
    shared = scratch.written(shared_keys(docs, k, percent, min(shards, 1 << 23)))
    met = shared.filter("need > 0").groupBy("id", "need").count().filter("count >= need").select("id").distinct()
    names = scratch.written(reps.select("id", "rep").join(met, "id"))
    stars = (
        shared.filter("id <> low").select("id", "low").distinct()
        .join(names, "id").select(F.col("rep").alias("b"), F.col("low").alias("id"))
        .join(names, "id").select(F.col("rep").alias("a"), "b")
        .filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    stars = scratch.written(stars)
    sets = scratch.written(set_table(docs, names.select(F.col("rep").alias("id")).distinct(), k))
    links = scratch.written(verified(stars, sets, k, percent))
    found = components(links)

    by_name = names.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("id", "rep", F.coalesce("component", "rep").alias("component"))
    labelled = shared.join(by_name, "id").select("key", "need", F.col("rep").alias("id"), "component")
    spans = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    spanning = labelled.filter("need > 0").join(spans, "key", "left_semi").groupBy("id", "component", "need").count()
    spanning = spanning.filter("count >= need").select("id", "component").distinct()
    spanning = scratch.written(spanning)
    if not spanning.isEmpty():
        own_sets = scratch.written(sets.join(spanning.select("id"), "id"))
        tokens = scratch.written(prefix_tokens(own_sets, k, percent))
        labels = spanning
        for most in (FEW, None):
            tested = scratch.written(candidate_pairs(tokens, own_sets, labels, percent, most).join(stars, ["a", "b"], "left_anti"))
            more = scratch.written(verified(tested, sets, k, percent))
            if more.isEmpty():
                continue
            links, stars = links.union(more), stars.union(tested)
            found = components(links)
            labels = scratch.written(spanning.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component")))
    scratch.clear()

    classes = first_of.select("rep", "held").join(found.withColumnRenamed("id", "rep"), "rep", "left").select("rep", "held", F.coalesce("component", "rep").alias("component"))
    placed = _beside(reps, classes, ["rep"], size[0]).select("id", "n", "component")
    return placed.unionByName(own.filter("n = 0").select("id", "n", F.col("id").alias("component")))

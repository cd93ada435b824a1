"""Benchmark decontamination by winnowing.

Of the hashes of the K-word grams in each window of words the least one is kept: the window's fingerprint.
Equal windows have equal fingerprints wherever they stand, so every span that a document shares with an item
and that is as long as a window holds a fingerprint of both.  Fingerprints of documents are joined with those
of items; a hit is extended to the windows that it was kept for, and these are joined with the items' windows
by a hash of all their words.  So all shared windows are found, and nothing but these (128 bits tell them apart).

Items of fewer words than a window are one window of their own length.  Documents look up all grams of the
lengths that occur (fewer than ``window``), as a winnowed document needn't keep such a short gram.

A bit filter of the items' fingerprints, sized by their number up to 2**FILTER_BITS bits, spares documents the
shuffle of most fingerprints; what passes it wrongly falls out in the join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluence.llm.common import id_set_bits, written
from confluence.llm.words import SIGNS, Words, batches, mix, rolling

#: Words of a window and of a gram: spans of WINDOW words and more are found.
WINDOW, K = 10, 5
#: The filter has 2**LEAST_BITS bits at least and 2**FILTER_BITS (16 MB) at most.
LEAST_BITS, FILTER_BITS = 16, 27
_SHORT = np.uint64(0xA0761D6478BD642F)


def fingerprints(hashes: np.ndarray, window: int, k: int) -> np.ndarray:
    """The least gram hash of the window of words from each position on."""
    grams = rolling(hashes, k)
    n = max(0, len(hashes) - window + 1)
    least = grams[:n].copy()
    for i in range(1, window - k + 1):
        np.minimum(least, grams[i : i + n], out=least)
    return least


def _inside(words: Words, size: int) -> np.ndarray:
    """The positions from which ``size`` words lie within one text."""
    n = max(0, len(words.start) - size + 1)
    return np.flatnonzero(words.doc[:n] == words.doc[size - 1 : size - 1 + n])


def _short(keys: np.ndarray) -> np.ndarray:
    """Fingerprints of windows that are shorter than WINDOW."""
    return mix(keys ^ _SHORT)


def item_windows(items: DataFrame, window: int = WINDOW, k: int = K, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (item_id, n, print, code): every window of every item, its words, fingerprint and hash.

    item_id is a string, empty for null ids; items without words have no window.
    """

    def run(source):
        for batch in batches(source):
            words = Words(batch.column(1), between=SIGNS)
            at = _inside(words, window)
            row, n = [words.doc[at]], [np.full(len(at), window)]
            prints, keys = [fingerprints(words.hash, window, k)[at]], [rolling(words.hash, window)[at]]
            for size in range(1, window):
                docs = np.flatnonzero(words.n_words == size)
                if len(docs):
                    key = rolling(words.hash, size)[words.first[docs]]
                    row.append(docs)
                    n.append(np.full(len(docs), size))
                    prints.append(_short(key))
                    keys.append(key)
            row, n, prints, keys = (np.concatenate(x) for x in (row, n, prints, keys))
            yield pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(n.astype(np.int32)), pa.array(prints.view(np.int64)), pa.array(keys.view(np.int64))], ["item_id", "n", "print", "code"])

    items = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), F.col(text).cast("string").alias("text"))
    return items.mapInArrow(run, "item_id string, n int, print long, code long").distinct()


SEEN = "doc_id long, n_words long, hits array<struct<print: long, spans: array<struct<at: int, n: int, code: long>>>>"


def seen(docs: DataFrame, bits: bytes, shorts: list[int], window: int = WINDOW, k: int = K, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprints that pass the filter, with the windows that they were kept for (columns as in SEEN)."""
    share = docs.sparkSession.sparkContext.broadcast(bits)

    def run(source):
        held = np.frombuffer(share.value, np.uint8)
        mask = np.uint64(8 * len(held) - 1)

        def known(prints):
            at = prints & mask
            return held[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1

        for batch in batches(source):
            words = Words(batch.column(1), between=SIGNS)
            place = _inside(words, window)
            prints = fingerprints(words.hash, window, k)[place]
            # neighbours in a text mostly keep the same gram: look each up once
            new = np.ones(len(place), bool)
            new[1:] = (prints[1:] != prints[:-1]) | (place[1:] != place[:-1] + 1)
            ok = np.zeros(len(place), bool)
            group = np.cumsum(new) - 1
            ok = known(prints[new])[group] if len(place) else ok
            at, size, prints = [place[ok]], [np.full(int(ok.sum()), window)], [prints[ok]]
            keys = [_at(words.hash, at[0], window)]
            for m in shorts:
                place = _inside(words, m)
                key = rolling(words.hash, m)[place]
                ok = known(_short(key))
                at.append(place[ok])
                size.append(np.full(int(ok.sum()), m))
                prints.append(_short(key[ok]))
                keys.append(key[ok])
            at, size, prints, keys = (np.concatenate(x) for x in (at, size, prints, keys))
            doc = words.doc[at]
            order = np.lexsort((at, size, doc))
            at, size, prints, keys, doc = (x[order] for x in (at, size, prints, keys, doc))
            # a fingerprint's hit: neighbouring windows of one text that keep it
            new = np.ones(len(at), bool)
            new[1:] = (prints[1:] != prints[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            spans = pa.StructArray.from_arrays([pa.array((at - words.first[doc]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(keys.view(np.int64))], ["at", "n", "code"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), spans)
            hits = pa.StructArray.from_arrays([pa.array(prints[first].view(np.int64)), lists], ["print", "spans"])
            edges = np.searchsorted(doc[first], np.arange(words.n_docs + 1))
            yield pa.record_batch([batch.column(0), pa.array(words.n_words.astype(np.int64)), pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), hits)], ["doc_id", "n_words", "hits"])

    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return docs.mapInArrow(run, SEEN)


def _at(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """``rolling`` at some positions only."""
    runs = hashes[at[:, None] + np.arange(size)] if len(at) else np.zeros((0, size), np.uint64)
    return rolling(runs.ravel(), size)[::size] if len(at) else np.zeros(0, np.uint64)


def overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, spans, windows), for reports and for cutting texts.

    rows: row, doc_id, n_words of every document; spans: row, at, n, print, code of each occurrence of an item's
    window (word numbers from 0); windows: item_id, n, print, code.  ``row`` tells documents apart, whatever their ids.
    """
    if not 0 < k <= window:
        raise ValueError("a gram has 1 word at least and no more than a window")
    windows = written(item_windows(items, window, k, item_id, text))
    prints = windows.select("print").distinct()
    counts = windows.groupBy("n").agg(F.count("*").alias("of")).collect()  # at most ``window`` rows
    log2_bits = min(FILTER_BITS, max(LEAST_BITS, (16 * sum(r.of for r in counts)).bit_length()))
    bits = id_set_bits(prints, "print", log2_bits, hashed=True)
    every = seen(docs, bits, sorted(r.n for r in counts if r.n < window), window, k, doc_id, text)
    rows = written(every.withColumn("row", F.monotonically_increasing_id()))
    hits = rows.filter(F.size("hits") > 0).select("row", F.inline("hits")).join(prints, "print", "left_semi")
    spans = hits.select("row", "print", F.inline("spans")).join(windows.select("print", "code").distinct(), ["print", "code"], "left_semi")
    return rows.select("row", "doc_id", "n_words"), spans.select("row", "at", "n", "print", "code"), windows


def judged(docs: DataFrame, items: DataFrame, window: int = WINDOW, k: int = K, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document.

    A word is hit if an occurrence of an item's window covers it.  Null and empty texts have no words and no hits;
    rows with null or repeated ids and repeated rows are judged each.  A null item_id counts as one item with
    an empty name; items of one text all count.  Without items nothing is hit; without documents the result is
    empty; very long texts are read whole; other columns are ignored.

    Items are looked up once for each set of windows that some document holds, not for each document, so a passage
    that many documents and many items share isn't multiplied out.
    """
    rows, spans, windows = overlaps(docs, items, window, k, doc_id, item_id, text)
    union = F.aggregate(
        F.array_sort("places"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["to"] - F.greatest(x["at"], s["upto"]))).alias("n"), F.greatest(s["upto"], x["to"]).alias("upto")),
        lambda s: s["n"].cast("long"),
    )
    held = spans.groupBy("row").agg(F.collect_list(F.struct("at", (F.col("at") + F.col("n")).alias("to"))).alias("places"), F.array_sort(F.collect_set(F.struct("print", "code"))).alias("codes"))
    name = F.sha2(F.array_join(F.transform("codes", lambda c: F.concat_ws(":", c["print"].cast("string"), c["code"].cast("string"))), ",").cast("binary"), 256)
    held = written(held.select("row", union.alias("n_hit"), name.alias("name"), "codes"))
    sets = held.groupBy("name").agg(F.first("codes").alias("codes")).select("name", F.inline("codes"))
    named = sets.join(windows.select("item_id", "print", "code"), ["print", "code"]).select("name", "item_id").distinct()
    named = named.groupBy("name").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("items"))
    found = held.select("row", "n_hit", "name").join(named, "name").select("row", "n_hit", "n_items", F.sha2(F.col("items").cast("binary"), 256).alias("items_sha256"))
    n_hit, n_items = (F.coalesce(c, F.lit(0).cast("long")) for c in ("n_hit", "n_items"))
    none = F.sha2(F.lit("").cast("binary"), 256)
    return rows.join(found, "row", "left").select("doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def sql(window: int = WINDOW) -> str:
    """The same rows over ``documents`` and ``benchmark`` in DuckDB's SQL: every window of every document, looked up."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
with docs as (select row_number() over () as r, doc_id, {words} as w from documents),
items as (select coalesce(cast(item_id as varchar), '') as item_id, {words} as w from benchmark),
item_windows as (
  select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as s
  from (select item_id, w, least(len(w), {window}) as n, unnest(range(1, greatest(len(w) - {window}, 0) + 2)) as i from items where len(w) > 0)),
doc_windows as (
  select r, i, n, array_to_string(w[i:i + n - 1], ' ') as s
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, (select distinct n from item_windows) where len(w) >= n)),
found as (select d.r, d.i, d.n, w.item_id from doc_windows d join item_windows w using (n, s)),
hit as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from (select distinct r, i, n from found)) group by r),
named as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct r, item_id from found) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join hit using (r) left join named using (r)"""

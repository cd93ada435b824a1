"""Quality rules with suffix-array repetition.

A batch's words get one suffix array by prefix doubling, text by text; only suffixes that
aren't unique yet take part in the next round.  The ranks of every round give the longest common
prefix of neighbours in it.  An interval of the array whose prefixes are long enough is a repeated
substring; it is never formed as such, as the longest prefix that a suffix shares is one with a
neighbour: the larger of its two gives the longest repeat that begins there.  The union of these spans
is the covered part of a text, the longest prefix its longest repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluence.llm.words import Words, batches, code_points

#: A repeat has at least so many words.
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: A text goes if repeats of LONG words or more cover over LONG_PERCENT of it, or one is longer than LONGEST words.
#: The share is half of what the base allows: of the 3,330 documents of sf0.1 that are labelled good and pass the base,
#: 4 have over 10 % (the most is 18.2 %).
LONG, LONG_PERCENT, LONGEST = 10, 10, 100
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_long_words long, longest_repeat long, base_failed boolean, kept boolean"


def repeats(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """For repeated WINDOW-word suffixes: (position, words that it shares with its best neighbour)."""
    total, last = len(words.hash), words.first[1:][words.doc] if len(words.hash) else np.zeros(0, np.int64)
    if not total:
        return last, last
    order = np.lexsort((words.hash, words.doc))
    turn = np.ones(total, bool)
    turn[1:] = (words.hash[order[1:]] != words.hash[order[:-1]]) | (words.doc[order[1:]] != words.doc[order[:-1]])
    begin = np.flatnonzero(turn)
    size = np.diff(np.append(begin, total))
    rank = np.empty(total, np.int64)  # of a group of suffixes: the place of its first one
    rank[order] = np.repeat(begin, size)
    active, k = order[np.repeat(size > 1, size)], 1
    repeated, levels = active, [rank.astype(np.int32)]
    while len(active):
        ahead = active + k
        second = np.where(ahead < last[active], rank[np.minimum(ahead, total - 1)], -1)
        order = np.lexsort((second, rank[active]))
        active, second = active[order], second[order]
        group = rank[active]
        start = np.ones(len(active), bool)
        start[1:] = group[1:] != group[:-1]
        turn = start.copy()
        turn[1:] |= second[1:] != second[:-1]
        begin = np.flatnonzero(turn)
        size = np.diff(np.append(begin, len(active)))
        base = np.flatnonzero(start)[np.cumsum(start) - 1]
        rank[active] = group + np.repeat(begin, size) - base
        active = active[np.repeat(size > 1, size)]
        levels.append(rank.astype(np.int32))
        k *= 2
        if k == 4:  # suffixes that no other shares four words with can't begin a repeat
            repeated = active
    sa = repeated[np.argsort(rank[repeated], kind="stable")]
    a, b = sa[:-1], sa[1:]
    same = words.doc[a] == words.doc[b] if len(sa) else np.zeros(0, bool)
    a, b = a[same], b[same]
    shared = common_prefix(levels, a, b, last)
    best = np.zeros(total, np.int64)
    np.maximum.at(best, a, shared)
    np.maximum.at(best, b, shared)
    found = np.flatnonzero(best >= WINDOW)
    return found, best[found]


def common_prefix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Equal words from positions a and b of one text on.

    ``levels[j]`` ranks suffixes by their first 2**j words, so equal ranks are equal words: the prefix is found
    from the longest step to the shortest, without any hash of a run.
    """
    out = np.zeros(len(a), np.int64)
    room = np.minimum(last[a] - a, last[b] - b) if len(a) else out
    for j in range(len(levels) - 1, -1, -1):
        fits = np.flatnonzero(room - out >= 1 << j)
        same = fits[levels[j][a[fits] + out[fits]] == levels[j][b[fits] + out[fits]]]
        out[same] += 1 << j
    return out


def covered(total: int, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of ``total`` words lie in a span."""
    edge = np.zeros(total + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:-1]) > 0


def per_row(row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, minlength=n).astype(np.int64)


def counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each text."""
    words = Words(texts, lower=False)
    n, data, offsets = words.n_docs, words.raw, words.offsets
    sums = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    within = lambda mask: (s := sums(mask))[offsets[1:]] - s[offsets[:-1]]
    out = {"n_words": words.n_words.astype(np.int64), "word_chars": code_points(data, offsets) - within(_BLANK[data]), "n_symbols": within(_SYMBOL[data])}
    newline = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offsets[:-1][offsets[:-1] < offsets[1:]], newline + 1]))
    begin = begin[begin < len(data)]
    row = np.searchsorted(offsets, begin, "right") - 1
    end = np.append(begin[1:], len(data))
    end = np.minimum(end, offsets[1:][row])
    end = np.where(data[np.maximum(end - 1, 0)] == 10, np.maximum(end - 1, begin), end) if len(begin) else end
    worded = np.searchsorted(words.start, end, "left") > np.searchsorted(words.start, begin, "left")
    begin, end, row = begin[worded], end[worded], row[worded]
    line = words.hashed(begin, end)
    order = np.lexsort((line, row))
    line, row = line[order], row[order]
    again = np.zeros(len(line), bool)
    again[1:] = (line[1:] == line[:-1]) & (row[1:] == row[:-1])
    out["n_dup_lines"] = per_row(row[again], n)
    at, length = repeats(words)
    out["n_repeat_words"] = per_row(words.doc[covered(len(words.hash), at, length)], n)
    long = length >= LONG
    out["n_long_words"] = per_row(words.doc[covered(len(words.hash), at[long], length[long])], n)
    out["longest_repeat"] = np.zeros(n, np.int64)
    np.maximum.at(out["longest_repeat"], words.doc[at], length)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    out["kept"] = ~(out["base_failed"] | (100 * out["n_long_words"] > LONG_PERCENT * out["n_words"]) | (out["longest_repeat"] > LONGEST))
    return out


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The measures and verdict of each row (columns as in SCHEMA).

    Null texts count as empty: no words, so base_failed.  Rows with null or repeated ids are
    measured like others; an empty table gives an empty result; other columns are ignored.
    """

    def run(source):
        for batch in batches(source):
            yield pa.record_batch({"doc_id": batch.column(0)} | {k: pa.array(v) for k, v in counts(batch.column(1)).items()})

    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return docs.mapInArrow(run, SCHEMA)


def passing(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, each by its own text, with all columns; ids aren't looked at."""
    others = [c for c in docs.columns if c != text]

    def run(source):
        for batch in batches(source):
            yield batch.filter(pa.array(counts(batch.column(1))["kept"]))

    own = docs.select(*others[:1], text, *others[1:])  # the text second, as ``batches`` takes it
    return own.mapInArrow(run, own.schema).select(docs.columns)

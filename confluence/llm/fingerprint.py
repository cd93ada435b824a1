"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit codes.

The hashes of a text's five-word shingles fall into BINS bins once; each bin keeps its
least hash.  An empty bin copies the first non-empty one along its own fixed random probes
(optimal densification).  A bin is stored as its minimum's lowest four bits, one hex digit, so
a fingerprint is BINS hex digits.  Likeness corrects the share of equal digits for the 1/16
that agree by chance.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluence.llm.words import Words, batches, mix

BINS, BITS, SHINGLE = 512, 4, 5
_REST = np.uint64(64 - (BINS - 1).bit_length())  # bits of a hash that don't choose its bin; BINS is a power of two
_DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)
_PROBES = (mix(np.arange(1, 2048 * BINS + 1, dtype=np.uint64)) % np.uint64(BINS)).astype(np.int64).reshape(2048, BINS)


def codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(digits[n, BINS], filled[n]): the bins' four-bit codes; filled is false for texts without words."""
    words = Words(texts)
    doc, values = words.shingles(SHINGLE)
    n = len(texts)
    values = mix(values)
    least = np.full(n * BINS, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(least, doc * BINS + (values >> _REST).astype(np.int64), values & np.uint64((1 << int(_REST)) - 1))
    least = least.reshape(n, BINS)
    held = least != np.uint64(0xFFFFFFFFFFFFFFFF)
    filled = held.any(axis=1)
    row, col = np.nonzero(~held & filled[:, None])
    for probe in _PROBES:
        if not len(row):
            break
        at = probe[col]
        ok = held[row, at]
        least[row[ok], col[ok]] = least[row[ok], at[ok]]
        row, col = row[~ok], col[~ok]
    for r, c in zip(row, col):  # no probe met a filled bin: the next one around
        least[r, c] = least[r, (c + np.flatnonzero(held[r][(c + np.arange(BINS)) % BINS])[0]) % BINS]
    return (mix(least) & np.uint64(15)).astype(np.uint8), filled


def as_text(digits: np.ndarray, filled: np.ndarray) -> list[str]:
    data = _DIGITS[digits].tobytes().decode()
    return [data[i * BINS : (i + 1) * BINS] if ok else "" for i, ok in enumerate(filled)]


def likeness(a, a_filled, b, b_filled) -> np.ndarray:
    """Bias-corrected similarity of fingerprints, row by row; two empty texts are alike."""
    chance = 1 / (1 << BITS)
    share = (a == b).mean(axis=1)
    out = np.clip((share - chance) / (1 - chance), 0, 1)
    return np.where(a_filled & b_filled, out, (a_filled == b_filled).astype(float))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of each row.  Null and empty texts get the empty fingerprint."""

    def run(source):
        for batch in batches(source):
            yield pa.record_batch([batch.column(0), pa.array(as_text(*codes(batch.column(1))), pa.string())], ["doc_id", "fingerprint"])

    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, fingerprint string")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text against an edited self and against the next document (columns as in SCHEMA).

    The edited text has its last floor(n_chars / 4) code points replaced by as many first ones
    (or all) of the next document by doc_id; the last one's next is the first.

    Null texts are empty, null ids come first, rows that share an id follow by text.  A lone row
    is its own next.  An empty table gives an empty result; other columns are ignored.

    Rows go once through a shuffle, by four ranges of ids for each of its tasks; ``spark.sql.shuffle.partitions`` says how many
    tasks there are.  Each range's first row also goes to the range before it.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.col(doc_id).isNull().alias("nameless"))
    tasks = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = 4 * tasks
    cuts = sorted({int(x) for x in docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) if x is not None})
    bounds = spark.sparkContext.broadcast(np.array(cuts, np.int64))  # eight bytes a part

    def placed(source):
        for batch in source:
            part = np.searchsorted(bounds.value, np.asarray(batch.column(0)), side="right").astype(np.int32)
            yield pa.record_batch([*batch.columns, pa.array(part)], [*batch.schema.names, "part"])

    ids = docs.select("doc_id").mapInArrow(placed, "doc_id long, part int")
    docs = docs.mapInArrow(placed, "doc_id long, text string, nameless boolean, part int")
    firsts = sorted((r.part, r.least) for r in ids.groupBy("part").agg(F.min("doc_id").alias("least")).collect())  # at most ``parts`` rows
    ahead = spark.createDataFrame([(least, firsts[i - 1][0]) for i, (_, least) in enumerate(firsts)], "doc_id long, before int")
    sent = docs.join(F.broadcast(ahead), "doc_id", "left").select(
        "doc_id", "text", "nameless",
        F.explode(F.array_compact(F.array(F.struct("part", F.lit(False).alias("peek")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("part"), F.lit(True).alias("peek")))))).alias("to"),
    ).select("doc_id", "text", "nameless", "to.part", "to.peek")

    def run(source):
        carry = None
        for batch in batches(source):
            if carry is not None:
                batch = pa.concat_batches([carry, batch])
            carry = batch.slice(batch.num_rows - 1)
            texts = batch.column(1).to_pylist()
            peek = batch.column(4).to_pylist()
            rows = [i for i in range(len(texts) - 1) if not peek[i]]
            if not rows:
                continue
            digits, filled = codes(batch.column(1))
            edited = []
            for i in rows:
                k = len(texts[i]) // 4
                edited.append(texts[i][: len(texts[i]) - k] + texts[i + 1][:k])
            e_digits, e_filled = codes(pa.array(edited, pa.large_string()))
            at = np.array(rows)
            nameless = np.asarray(batch.column(2).take(pa.array(rows)))
            yield pa.record_batch(
                [
                    pa.array(np.asarray(batch.column(0))[at], mask=nameless),
                    pa.array([len(texts[i]) for i in rows], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
                    pa.array(as_text(digits[at], filled[at]), pa.string()),
                    pa.array(as_text(e_digits, e_filled), pa.string()),
                    pa.array(likeness(digits[at], filled[at], e_digits, e_filled)),
                    pa.array(likeness(digits[at], filled[at], digits[at + 1], filled[at + 1])),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    shuffled = sent.repartition(tasks, "part").sortWithinPartitions("part", "peek", "doc_id", "text")
    return shuffled.mapInArrow(run, SCHEMA)

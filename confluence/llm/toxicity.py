"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features are lexicon densities (a stated lexicon, and stems that the labels teach), hits near a
second-person pronoun, capitals, punctuation and obfuscation rates.  Labelled documents are dealt
into three parts by a hash: one teaches the stems, one the trees, one the calibration.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluence.llm.common import crc_mod5, written
from confluence.llm.words import Words, batches

# Insults, second-person pronouns.
LEXICON = (
    "asshole", "bastard", "bitch", "clown", "crap", "dickhead", "disgusting", "dumb", "dumbass", "filth", "fool", "freak",
    "fuck", "fucking", "garbage", "idiot", "idiotic", "idiots", "imbecile", "jerk", "loser", "losers", "moron", "moronic",
    "morons", "pathetic", "pig", "scum", "shit", "slut", "stupid", "trash", "ugly", "vermin", "whore", "worthless",
)
SECOND_PERSON = (
    "you", "your", "yours", "yourself", "u", "ur", "tu", "toi", "te", "ton", "ta", "tes", "vous", "votre", "vos", "du", "dich",
    "dir", "dein", "deine", "ihr", "euch", "euer", "tú", "ti", "vosotros", "usted", "ustedes", "vuestro",
)
NEAR = 5  # words between a hit and a pronoun, at most
STEMS = (4, 5, 6)  # bytes of a word's beginning that count as a stem
#: Labelled rows that are learnt from, at most, and stems that are kept, at most.
SAMPLE, LEARNT = 24_000, 600
TREES, DEPTH = 24, 4
FEATURES = (
    "log_words", "insults", "insult_density", "stems", "stem_density", "strong_stem_density", "near_second_person", "second_person",
    "upper_letters", "upper_words", "exclamations", "questions", "punctuation", "obfuscated", "masked_insults", "long_runs",
)
_TRIM = np.zeros(256, bool)
_TRIM[np.frombuffer(b".,;:!?\"'()[]{}<>-_*#~|", np.uint8)] = True
_LEET = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"013457@$", b"oieastas"):
    _LEET[_a] = _b


def _tokens(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Words without the punctuation around them (at most four bytes on each side)."""
    start, end = words.start.copy(), words.end.copy()
    for _ in range(4):
        start += (start < end - 1) & _TRIM[words.data[np.minimum(start, len(words.data) - 1)]]
        end -= (start < end - 1) & _TRIM[words.data[end - 1]]
    return start, end


def _hashes(names) -> np.ndarray:
    return np.sort(Words(pa.array([" ".join(names)])).hash)


def _in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    return table[np.minimum(at, len(table) - 1)] == values


def stems_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word and of its stems."""
    start, end = _tokens(words)
    rows, out = [words.doc], [words.hashed(start, end)]
    for size in STEMS:
        long = end - start > size
        rows.append(words.doc[long])
        out.append(words.hashed(start[long], start[long] + size) ^ np.uint64(size))
    return np.concatenate(rows), np.concatenate(out)


def features(texts: pa.Array, learnt: np.ndarray, strong: np.ndarray) -> np.ndarray:
    """[text, feature]; ``learnt`` and ``strong`` are sorted hashes of taught stems."""
    words = Words(texts)
    n, raw, data, offsets = words.n_docs, words.raw, words.data, words.offsets
    count = lambda rows: np.bincount(rows, minlength=n).astype(float)

    def within(mask):
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)

    total, chars = np.maximum(words.n_words, 1).astype(float), np.maximum(np.diff(offsets), 1).astype(float)
    start, end = _tokens(words)
    word = words.hashed(start, end)
    insult = _in(word, _hashes(LEXICON))
    taught, firm = _in(word, learnt), _in(word, strong)
    for size in STEMS:
        long = np.flatnonzero(end - start > size)
        stem = words.hashed(start[long], start[long] + size) ^ np.uint64(size)
        taught[long] |= _in(stem, learnt)
        firm[long] |= _in(stem, strong)
    you = _in(word, _hashes(SECOND_PERSON))
    sums = np.concatenate([[0], np.cumsum(you)])
    at = np.arange(len(word))
    low = np.maximum(at - NEAR, words.first[:-1][words.doc])
    high = np.minimum(at + NEAR + 1, words.first[1:][words.doc])
    near = (insult | firm) & (sums[high] > sums[low])
    upper, lower = (raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122)
    up, letters = np.concatenate([[0], np.cumsum(upper)]), np.concatenate([[0], np.cumsum(upper | lower)])
    word_letters = letters[words.end] - letters[words.start]
    shouted = (word_letters >= 3) & (up[words.end] - up[words.start] == word_letters)
    odd = ((raw >= 48) & (raw <= 57)) | (raw == 64) | (raw == 36) | (raw == 42)
    odds = np.concatenate([[0], np.cumsum(odd)])
    obfuscated = (word_letters >= 2) & (odds[end] - odds[start] > 0)
    masked = np.zeros(len(word), bool)
    some = np.flatnonzero(obfuscated)
    if len(some):  # read digits and signs as the letters that they look like
        clear = [bytes(_LEET[data[a:b]]).decode("utf-8", "replace").replace("*", "").replace(" ", "") or "-" for a, b in zip(start[some], end[some])]
        masked[some] = _in(Words(pa.array([" ".join(clear)])).hash, _hashes(LEXICON))
    same = np.zeros(len(data), bool)
    same[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & (upper | lower)[2:]
    punctuation = ((raw >= 33) & (raw <= 47)) | ((raw >= 58) & (raw <= 63))
    columns = [
        np.log1p(words.n_words), np.log1p(count(words.doc[insult])), count(words.doc[insult]) / total, np.log1p(count(words.doc[taught])),
        count(words.doc[taught]) / total, count(words.doc[firm]) / total, count(words.doc[near]) / total, count(words.doc[you]) / total,
        within(upper) / np.maximum(within(upper | lower), 1), count(words.doc[shouted]) / total, within(raw == 33) / chars, within(raw == 63) / chars,
        within(punctuation) / chars, count(words.doc[obfuscated]) / total, count(words.doc[masked]) / total, within(same) / chars,
    ]
    return np.stack(columns, axis=1)


def _plain(docs: DataFrame, doc_id: str, text: str, *more) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *more)


def learnt_stems(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Stems that tell toxic texts of ``sample`` (doc_id, text, toxic): all, and those with firm evidence."""

    def run(source):
        for batch in batches(source):
            words = Words(batch.column(1))
            row, stem = stems_of(words)
            order = np.lexsort((stem, row))
            row, stem = row[order], stem[order]
            keep = np.ones(len(row), bool)
            keep[1:] = (row[1:] != row[:-1]) | (stem[1:] != stem[:-1])
            toxic = np.asarray(batch.column(2).cast(pa.int64()))[row[keep]]
            name, at = np.unique(stem[keep], return_inverse=True)
            bad, all_ = np.bincount(at, toxic, len(name)).astype(np.int64), np.bincount(at, minlength=len(name)).astype(np.int64)
            yield pa.record_batch([pa.array(name.view(np.int64)), pa.array(bad), pa.array(all_ - bad)], ["stem", "bad", "good"])

    sizes = sample.agg(F.sum("toxic"), F.count("*")).first()
    toxic, clean = float(sizes[0] or 0), float((sizes[1] or 0) - (sizes[0] or 0))
    counted = sample.select("doc_id", "text", "toxic").mapInArrow(run, "stem long, bad long, good long").groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    ratio = F.log((F.col("bad") + 0.5) / (toxic + 1)) - F.log((F.col("good") + 0.5) / (clean + 1))
    firm = ratio / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    best = counted.filter("bad >= 4").withColumns({"ratio": ratio, "firm": firm}).filter("ratio > 2 and firm > 2.5").orderBy(F.desc("firm"), "stem").limit(LEARNT).collect()
    as_hashes = lambda rows: np.sort(np.array([r.stem for r in rows], np.int64).view(np.uint64))
    return as_hashes(best), as_hashes([r for r in best if r.firm > 4])


class Scorer:
    """A fitted model: stems, trees and calibration.

    A score is the isotonic value, which is a step function, with a thousandth of the trees' own chance mixed in:
    so rows of one step keep their order, and no score moves by more than 0.001.
    """

    def __init__(self, stems, trees, calibration):
        self.stems, self.trees, self.calibration = stems, trees, calibration

    def scored(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, score, predicted) of each row."""
        return self._calibrated(_plain(docs, doc_id, text), [])

    def passing(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """The rows of ``docs`` that aren't predicted toxic, with all columns.

        Each row goes or stays by its own text: its columns travel with its score, so rows with null or
        repeated ids don't decide about each other.
        """
        own = {c: f"in_{i}" for i, c in enumerate(docs.columns) if c != text}
        plain = _plain(docs, doc_id, text, *[F.col(c).alias(name) for c, name in own.items()])
        clean = self._calibrated(plain, ["text", *own.values()]).filter("predicted = 0")
        return clean.select([F.col(own.get(c, "text")).alias(c) for c in docs.columns])

    def _calibrated(self, docs: DataFrame, carried: list[str]) -> DataFrame:
        """(doc_id, carried columns, score, predicted) of each row."""
        raw = self._raw(docs, carried)
        if self.calibration is not None:
            raw = self.calibration.transform(raw).withColumn("raw", F.col("score") * 0.999 + F.col("raw") * 0.001).drop("score")
        score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("raw", F.lit(0.0))))
        return raw.select("doc_id", *carried, score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

    def _raw(self, docs: DataFrame, carried: list[str]) -> DataFrame:
        dense = with_features(docs, *self.stems, carried)
        if self.trees is None:
            return dense.select("doc_id", *carried, F.lit(0.0).alias("raw"))
        chance = vector_to_array("probability")[1]
        return self.trees.transform(dense.withColumn("features", array_to_vector("dense"))).select("doc_id", *carried, chance.alias("raw"))


def with_features(docs: DataFrame, learnt: np.ndarray, strong: np.ndarray, carried: list[str] | None = None) -> DataFrame:
    """(doc_id, dense) and the ``carried`` columns, or those behind the first two of ``docs``."""
    kept = docs.columns[2:] if carried is None else carried

    def run(source):
        for batch in batches(source):
            table = features(batch.column(1), learnt, strong)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1) * len(FEATURES), pa.int32()), pa.array(table.ravel()))
            yield pa.record_batch([batch.column(0), flat, *(batch.column(c) for c in kept)], ["doc_id", "dense", *kept])

    rest = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.mapInArrow(run, f"doc_id long, dense array<double>{rest}")


def fitted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Scorer:
    """Learns from at most ``sample`` rows of ``labels`` (doc_id, toxic), those with the least hashes.

    Labels that are null count as absent.  Without toxic or clean rows every score is 0.
    """
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    some = some.withColumn("deal", F.xxhash64("doc_id")).orderBy("deal", "doc_id").limit(sample)
    some = some.withColumn("part", F.pmod(F.shiftright("deal", 8), F.lit(20))).select("doc_id", "toxic", "part")
    # at most ``sample`` small rows, so a broadcast of a known size
    known = written(_plain(docs, doc_id, text).join(F.broadcast(some), "doc_id"))
    sizes = {(r.part, r.toxic): r["count"] for r in known.groupBy("part", "toxic").count().collect()}
    if not all(any(n for (_, y), n in sizes.items() if y == t) for t in (0, 1)):
        return Scorer((np.zeros(0, np.uint64),) * 2, None, None)
    stems = learnt_stems(known.filter("part < 9"))
    dense = with_features(known.filter("part >= 9"), *stems)
    dense = written(dense.withColumn("features", array_to_vector("dense")).withColumn("label", F.col("toxic").cast("double")))
    trained, held = dense.filter("part < 16").coalesce(2).cache(), dense.filter("part >= 16")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.25, minInstancesPerNode=5, seed=7, maxBins=64).fit(trained)
    trained.unpersist()
    scorer = Scorer(stems, trees, None)
    guessed = trees.transform(held).select(vector_to_array("probability")[1].alias("raw"), "label").coalesce(1)
    if guessed.isEmpty():
        return scorer
    scorer.calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(guessed)
    return scorer


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of each row; learnt from labelled rows that aren't held out.

    Rows with crc32(doc_id as text) mod 5 = 0 are held out.  Null and empty texts are scored by their
    (zero) features.  Null ids are never learnt from; repeated rows are scored each.  An empty table gives
    an empty result, empty labels score 0; other columns are ignored.
    """
    scorer = fitted(docs, labels.filter(crc_mod5() != 0), doc_id, text)
    return scorer.scored(docs, doc_id, text).select("doc_id", (crc_mod5() == 0).alias("held_out"), "score", "predicted")

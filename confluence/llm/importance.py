"""Target-distribution importance resampling over hashed features, scored without exploding documents.

A document's features (runs of 1 to ``order`` words) are an array of bucket numbers, made by higher-order functions.
Bucket totals of the raw corpus and of the target are the only counts that are shuffled: at most BUCKETS rows a task.
A bucket's gain, the log of its share in the target over its share in the corpus, goes back into the plan as one
literal array, and a document's weight is an ``aggregate`` over its buckets' elements of it.  Gumbel noise from the
document's id makes the highest scores a draw without replacement.

Ranks come from one sort by ranges of (score, id): a row's place is its place within its range plus the rows of the
ranges before, so no window runs over all rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluence.llm.common import written

BUCKETS, ORDER = 10_000, 1
#: Drawn documents have this many words at least; PERCENT of these are drawn.
LEAST_WORDS, PERCENT = 20, 10
SEED, SCALE = 2024, 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A row's place in a sorted table: the number of its part above PART bits, its place within below.
PART = 33


def words(text: Column) -> Column:
    """The words of a text; none for a null text."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), F.lit(WORD), 0)


def features(held: Column, order: int = ORDER) -> Column:
    """All runs of 1 to ``order`` consecutive words, joined by a space."""

    def runs(n):  # words are taken by their place, so a text costs no more than its length
        firsts = F.slice(held, F.lit(1), F.greatest(F.size(held) - (n - 1), F.lit(0)))
        return F.transform(firsts, lambda word, i: F.concat_ws(" ", word, *[F.get(held, i + k) for k in range(1, n)]))

    return held if order == 1 else F.concat(held, *[runs(n) for n in range(2, order + 1)])


def bucketed(docs: DataFrame, text: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with ``_words`` (int) and ``_buckets``, the bucket of each feature."""
    return docs.withColumn("_w", words(F.col(text))).select(
        *[c for c in docs.columns if c != text], F.size("_w").alias("_words"),
        F.transform(features(F.col("_w"), order), lambda x: (F.crc32(x.cast("binary")) % buckets).cast("int")).alias("_buckets"),
    )


def totals(docs: DataFrame, text: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> list[int]:
    """How many features of all rows each bucket has; counted in every task before the shuffle, ``buckets`` rows reach the driver."""
    # not explode: Catalyst would make the arrays once more to see whether they are empty
    each = bucketed(docs.select(text), text, order, buckets).select(F.explode_outer("_buckets").alias("bucket"))
    out = [0] * buckets
    for r in each.groupBy("bucket").agg(F.count("*").alias("n")).collect():
        if r.bucket is not None:
            out[r.bucket] = r.n
    return out


def gains(corpus: list[int], target: list[int], scale: int = SCALE) -> list[int]:
    """floor(scale * ln(target share / corpus share)) of each bucket, both with one feature more in every bucket."""
    b, s_all, t_all = len(corpus), float(sum(corpus)), float(sum(target))
    return [math.floor(scale * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b)))) for s, t in zip(corpus, target)]


def noise(doc_id: Column, seed: int = SEED, scale: int = SCALE) -> Column:
    """Gumbel noise of an id: from the first 32 bits of a digest of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored(docs: DataFrame, gain: list[int], seed: int = SEED, order: int = ORDER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score of each row: map only."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded to one literal array
    weight = F.aggregate("_buckets", F.lit(0).cast("bigint"), lambda total, x: total + F.element_at(table, x + 1))
    held = bucketed(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), "text", order, len(gain))
    held = held.select("doc_id", F.col("_words").cast("long").alias("n_words"), F.size("_buckets").cast("long").alias("n_features"), weight.alias("weight"))
    return held.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def ranked(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds ``rank``: 1, 2, ... for the drawn rows, null for others.

    Rows that may be drawn come first, by score downwards, then by doc_id (null ids last); equal rows in any order.  The sort
    has a key that tells equal rows apart, so no range grows with repeated rows.
    """
    spark = rows.sparkSession
    rows = written(rows)  # a sort by ranges reads its input twice
    may = F.col("n_words") >= least_words
    keyed = rows.withColumn("_may", may).withColumn("_own", F.monotonically_increasing_id())
    order = [F.desc("_may"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_own")]
    placed = written(keyed.orderBy(*order).drop("_own").withColumn("_at", F.monotonically_increasing_id()))
    parts = placed.groupBy(F.shiftright("_at", PART).alias("part")).agg(F.count("*").alias("n"), F.count_if("_may").alias("may")).orderBy("part").collect()  # one row a range
    before, so_far = [], 0
    for r in parts:
        before.append((r.part, so_far))
        so_far += r.n
    drawn = percent * sum(r.may for r in parts) // 100
    base = spark.createDataFrame(before, "_part long, _before long")
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << PART) - 1)) + 1
    out = placed.withColumn("_part", F.shiftright("_at", PART)).join(F.broadcast(base), "_part", "left").withColumn("rank", F.when(rank <= drawn, rank))
    return out.drop("_part", "_before", "_at", "_may")


def drawn(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, order: int = ORDER, buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document (all long); ``rank`` is null unless it is drawn.

    A null or empty text has no features and a weight of 0.  The noise of a null id is that of an empty name; rows
    with one id have one noise, and each of them may be drawn.  Repeated rows are scored each.  Of equal scores the smaller
    doc_id comes first, null ids last.  Very long texts are read whole.  An empty table of documents gives an empty result, an empty
    target gains that only tell rare buckets from frequent ones.  Other columns are ignored.
    """
    gain = gains(totals(docs, text, order, buckets), totals(target, text, order, buckets))
    return ranked(scored(docs, gain, seed, order, doc_id, text), percent, least_words).select("doc_id", "n_features", "weight", "score", "rank")


def sql(buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> str:
    """The same rows over ``documents`` and ``benchmark`` in DuckDB's SQL, for single words; crc32 is computed bit by bit."""
    words_of = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    step = "case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
    table = "select i, i as c from range(256) t(i)"
    for _ in range(8):
        table = f"select i, {step} as c from ({table})"
    return f"""
with entries as (select list(c order by i) as entry from ({table})),
docs as (select row_number() over () as r, doc_id, {words_of} as w from documents),
doc_words as (select r, unnest(w) as word from docs),
target_words as (select unnest({words_of}) as word from benchmark),
bytes as (
  select word, list_transform(range(octet_length(encode(word))), lambda i: cast('0x' || substr(hex(encode(word)), cast(2 * i + 1 as integer), 2) as bigint)) as b
  from (select word from doc_words union select word from target_words)),
bucket_of as (
  select word, xor(list_reduce(list_prepend(cast(4294967295 as bigint), b), lambda c, x: xor(entry[xor(c & 255, x) + 1], c >> 8)), 4294967295) % {buckets} as bucket
  from bytes, entries),
corpus as (select bucket, count(*) as n from doc_words join bucket_of using (word) group by bucket),
target as (select bucket, count(*) as n from target_words join bucket_of using (word) group by bucket),
sums as (select coalesce((select sum(n) from corpus), 0)::double as s, coalesce((select sum(n) from target), 0)::double as t),
gain as (
  select c.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1.0::double) * (s + {buckets}) / ((c.n + 1.0::double) * (sums.t + {buckets}))))::bigint as gain
  from corpus c left join target t using (bucket), sums),
weights as (select r, count(*) as n_features, sum(gain)::bigint as weight from doc_words join bucket_of using (word) join gain using (bucket) group by r),
scored as (
  select r, doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((cast('0x' || substr(sha256('{seed}:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5::double) / 4294967296.0::double)))::bigint as score
  from docs left join weights using (r)),
ordered as (select r, row_number() over (order by score desc, doc_id nulls last) as place, count(*) over () as n from scored where n_features >= {least_words})
select doc_id, n_features, weight, score, case when place <= {percent} * n // 100 then place end as rank
from scored left join ordered using (r)"""

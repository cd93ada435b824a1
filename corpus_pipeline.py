"""A corpus from ``documents`` to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of ``documents``, in their order.  Every row is judged by itself: rows with null ids or
with ids that other rows have too are neither dropped nor kept for the sake of those.  Nulls in lang, source or
n_chars pass through all stages; an empty table gives an empty result of the same columns; very long texts are
read whole.  Further columns of the input are carried along, whatever their names, up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from confluence.llm import ngram_join, packing, pii, repetition, toxicity
from confluence.llm.common import crc_mod5, table, written

#: Near-duplicate documents share this percentage of their five-word shingles, or more.
SHINGLE, PERCENT = 5, 80


def drop_toxic(spark, docs, sf_dir):
    """Rows whose text the toxicity model predicts toxic go, and no others; null and empty texts are scored as texts
    without words.  Repeated rows go or stay together, as their texts are equal."""
    labels = table(spark, sf_dir, "labels").filter(crc_mod5() != 0)
    return toxicity.fitted(docs, labels).passing(docs)


def drop_low_quality(spark, docs, sf_dir):
    """Rows whose text fails the quality rules go, and no others: null and empty texts have too few words and go.
    Repeated rows go or stay together."""
    return repetition.passing(docs)


def drop_near_duplicates(spark, docs, sf_dir):
    """One row of each linked group stays: that with the smallest doc_id, nulls last; of equal ids any one.

    Rows are told apart by doc_id where it is a key, else by a row key written with the stage's input.  So
    copies with null ids or with one id are linked as others are, and a different text under a copy's id
    stays.  Texts without words link with nothing and stay.
    """
    if docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").isEmpty():
        groups = ngram_join.linked_components(docs, k=SHINGLE, percent=PERCENT)
        extra = groups.filter(F.col("component_id") != F.col("doc_id")).select("doc_id")
        return docs.join(extra, "doc_id", "left_anti").select(docs.columns)
    own = written(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")))
    groups = ngram_join.linked_components(own.select("row", "doc.text"), k=SHINGLE, percent=PERCENT, doc_id="row")
    members = written(groups.select(F.col("doc_id").alias("row"), "component_id").join(own.select("row", "doc.doc_id"), "row"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first")
    stays = members.groupBy("component_id").agg(first).select(F.col("first.row").alias("row"))
    return own.join(stays, "row", "left_semi").select("doc.*")


def replace_personal_data(spark, docs, sf_dir):
    """Personal data becomes pseudonyms; n_chars follows the text (null for null texts).  All rows stay; equal values get
    equal pseudonyms in all of them."""
    return pii.pseudonymised(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack(spark, docs, sf_dir):
    """Pieces of the documents, placed in sequences; null and empty texts are one piece of one id.  Repeated rows and
    rows with null ids are packed each."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("PII", replace_personal_data),
    ("best-fit packing", pack),
]

#: Trained and rank-based stages are no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

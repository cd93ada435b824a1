"""The queries of the numbered operators and the pipeline, and their SQL where SQL can say it."""

from __future__ import annotations

import corpus_pipeline
from confluence.llm import align, bpe, decontaminate, fingerprint, importance, lm, ngram_join, packing, pii, repetition, toxicity, url_filter, warc
from confluence.llm.common import table


def op1_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.linked_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op2_document_fingerprints(spark, sf_dir):
    return fingerprint.neighbours(table(spark, sf_dir, "documents"))


def op3_url_filters(spark, sf_dir):
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality_rules(spark, sf_dir):
    return repetition.measured(table(spark, sf_dir, "documents"))


def op7_pii(spark, sf_dir):
    return pii.judged(table(spark, sf_dir, "documents"))


def op8_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_lm_scoring(spark, sf_dir):
    return lm.judged(table(spark, sf_dir, "documents"))


def op10_byte_level_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark, sf_dir):
    return align.judged(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark, sf_dir):
    return importance.drawn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_decontamination(spark, sf_dir):
    return decontaminate.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


def queries():
    own = (
        op1_ngram_jaccard_join, op2_document_fingerprints, op3_url_filters, op4_best_fit_packing, op5_toxicity, op6_quality_rules,
        op7_pii, op8_warc, op9_lm_scoring, op10_byte_level_bpe, op11_token_alignment, op12_importance_resampling, op13_decontamination, pipeline,
    )
    return {f.__name__: f for f in own}


def oracle_sql():
    sql = {"op3_url_filters": url_filter.sql(), "op8_warc": warc.sql(), "op12_importance_resampling": importance.sql(), "op13_decontamination": decontaminate.sql()}
    sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {name: text for name, text in sql.items() if text}

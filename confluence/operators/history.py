"""Run history: tables partitioned by run_id, and their read side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def save(df: DataFrame, path: str) -> None:
    """Writes a run's rows; the same run_id written again replaces its rows, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """All runs; columns that older runs lack are null."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def recent_runs(runs: DataFrame, n: int) -> DataFrame:
    """The n newest runs."""
    return runs.orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)


def with_best_zone(candidates: DataFrame, zones: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates with their best zone, or nulls."""
    return candidates.join(zones.filter("is_best"), keys, "left")


def run_list(candidates: DataFrame, run_id, only_passed: bool = False) -> DataFrame:
    """A run's candidates by momentum, strongest first, then by symbol; on demand only those that passed step 1."""
    own = candidates.filter(F.col("run_id") == F.lit(run_id))
    return (own.filter("passed") if only_passed else own).orderBy(F.desc("momentum_score"), "symbol")


def detail(rows: DataFrame, run_id, symbol: str) -> DataFrame:
    """The rows of one candidate of one run; the filters reach the files' partitions and statistics."""
    return rows.filter((F.col("run_id") == F.lit(run_id)) & (F.col("symbol") == F.lit(symbol)))


def run_label(started: Column, passed: Column, universes: Column) -> Column:
    """``2026-05-28 17:24 — 50 candidatos (sp500+nasdaq100)``; without universes no brackets."""
    tags = F.when(F.size(universes) > 0, F.concat(F.lit(" ("), F.array_join(universes, "+"), F.lit(")"))).otherwise("")
    return F.concat(F.date_format(started, "yyyy-MM-dd HH:mm"), F.lit(" — "), passed.cast("string"), F.lit(" candidatos"), tags)


def file_label(date: Column, hhmm: Column) -> Column:
    """``2026-05-22 22:00 UTC``."""
    return F.concat(date.cast("string"), F.lit(" "), F.substring(hhmm, 1, 2), F.lit(":"), F.substring(hhmm, 3, 2), F.lit(" UTC"))


def by_score(rows: DataFrame, tie: str = "symbol") -> DataFrame:
    return rows.orderBy(F.desc_nulls_last("score"), tie)


def report_files(names: DataFrame, name: str = "name") -> DataFrame:
    """date, hhmm, html, csv of report files, newest first; names of another form and entries without html are left out."""
    form = r"^screening_(\d{4}-\d{2}-\d{2})_(\d{4})\.(html|csv)$"
    part = lambda i: F.regexp_extract(name, form, i)
    found = names.filter(F.col(name).rlike(form)).select(part(1).alias("date"), part(2).alias("hhmm"), part(3).alias("ext"), name)
    pairs = found.groupBy("date", "hhmm").agg(F.max(F.when(F.col("ext") == "html", F.col(name))).alias("html"), F.max(F.when(F.col("ext") == "csv", F.col(name))).alias("csv"))
    return pairs.filter("html is not null").orderBy(F.desc("date"), F.desc("hhmm"))

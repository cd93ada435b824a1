"""Sources: ordered fallback, upserts, covered slices, cached files with a time to live, text formats."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confluence.config import REFRESH_BARS
from confluence.sources.projections import SOURCES

#: (source, entity) -> a function that gives a DataFrame.
READERS: dict[tuple[str, str], Callable[..., DataFrame]] = {}
BARS = "Date date, Open double, High double, Low double, Close double, Volume double"
MACRO_KINDS = ("fomc", "cpi", "ppi", "nfp", "gdp", "other")


class SourceError(Exception):
    """A source has failed or has nothing to give."""


def register_reader(source: str, entity: str, reader: Callable[..., DataFrame]) -> None:
    """Adds what a source knows of an entity."""
    READERS[source, entity] = reader


def supports(source: str, entity: str) -> bool:
    return (source, entity) in READERS


def read(entity: str, keys: list[str], order: dict[str, tuple[str, ...]] = SOURCES, *args) -> DataFrame:
    """Rows of an entity: for each key from the first source in ``order`` that knows it; a source that fails is passed over.

    SourceError where no source is left.
    """
    found = {}
    for source in order[entity]:
        if supports(source, entity):
            try:
                found[source] = READERS[source, entity](*args)
            except SourceError:
                continue
    if not found:
        raise SourceError(f"no source for {entity}")
    return resolved(found, keys)


def refreshed(cached: DataFrame, fetch: Callable[[], DataFrame], keys: list[str], date: str = "date", bars: int = REFRESH_BARS) -> DataFrame:
    """``cached`` with the newest bars of each symbol fetched again; if the source fails, what is cached stands."""
    try:
        fresh = fetch()
    except SourceError:
        return cached
    newest = W.partitionBy(*[k for k in keys if k != date]).orderBy(F.desc(date))
    return merged(cached, fresh.withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= bars).drop("_back"), keys)


def write_cache(df: DataFrame, path: str, enabled: bool = True) -> bool:
    """Writes a cache's rows; nothing where caching is off."""
    if enabled:
        df.write.mode("overwrite").parquet(path)
    return enabled


def resolved(sources: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """The row of the first source, in the order given, that has one for a key; ``source`` says which."""
    parts = [df.withColumns({"source": F.lit(name), "_rank": F.lit(i)}) for i, (name, df) in enumerate(sources.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    first = W.partitionBy(*keys).orderBy("_rank")
    return out.withColumn("_pick", F.row_number().over(first)).filter("_pick = 1").drop("_pick", "_rank")


def merged(cached: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """``cached`` with the keys of ``fresh`` replaced by its rows."""
    return cached.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def covered(df: DataFrame, start: str, end: str, keys: list[str], date: str = "date") -> DataFrame:
    """Rows of start .. end, for keys whose rows span that range; others are a miss."""
    span = df.groupBy(*keys).agg(F.min(date).alias("_from"), F.max(date).alias("_to")).filter((F.col("_from") <= F.lit(start).cast("date")) & (F.col("_to") >= F.lit(end).cast("date")))
    return df.filter(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date"))).join(span.select(*keys), keys, "left_semi")


def fresh_files(spark: SparkSession, path: str, kind: str, hours: float, now: datetime.datetime) -> DataFrame:
    """A file source's rows from files changed within so many hours before ``now``."""
    least = now - datetime.timedelta(hours=hours)
    return spark.read.format(kind).load(path).filter(F.col("_metadata.file_modification_time") >= F.lit(least))


def price_csv(spark: SparkSession, path: str) -> DataFrame:
    """date, open, high, low, close, volume from CSV files with a header; lines without a date are dropped.

    A source that has nothing answers with a line without a date: SourceError.
    """
    df = spark.read.csv(path, header=True, schema=BARS, mode="PERMISSIVE", enforceSchema=True)
    if df.filter("Date is not null").isEmpty():
        raise SourceError(f"no data in {path}")
    return df.filter("Date is not null").select(*[F.col(c).alias(c.lower()) for c in df.columns])


def macro_calendar(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """date, kind, description from a calendar's entries; an unknown kind or a bad date raises ValueError."""
    out = []
    for row in rows:
        if row.get("kind") not in MACRO_KINDS:
            raise ValueError(f"unknown kind: {row.get('kind')!r}")
        out.append((datetime.date.fromisoformat(str(row["date"])), row["kind"], row.get("description", "")))
    return spark.createDataFrame(out, "date date, kind string, description string")


def macro_file(spark: SparkSession, path: str) -> DataFrame:
    """date, kind, description of a calendar's JSON file; an unknown kind or a bad date raises ValueError."""
    df = spark.read.schema("date date, kind string, description string").json(path, multiLine=True)
    odd = df.filter(F.col("date").isNull() | ~F.coalesce(F.col("kind").isin(*MACRO_KINDS), F.lit(False))).first()
    if odd is not None:
        raise ValueError(f"bad entry: {odd.asDict()}")
    return df.withColumn("description", F.coalesce("description", F.lit("")))

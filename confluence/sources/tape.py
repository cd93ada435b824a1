"""Daily bars derived from the order tables, as they hold no price series.

A day's return is the day's mean discount about 5 %; closes are the running product, highs and lows follow
from taxes, volume from quantities.  Sums run over integers, so the order of rows doesn't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str, symbol: str = "p_type") -> DataFrame:
    """symbol, date, open, high, low, close, volume; one row per symbol and weekday with trades."""
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_shipdate").cast("date").alias("date"), "l_discount", "l_tax", "l_quantity")
    parts = read(spark, sf_dir, "part").select("p_partkey", F.col(symbol).alias("symbol"))
    whole = lambda c: F.round(F.col(c) * 100).cast("long")
    days = (
        lines.filter(~F.dayofweek("date").isin(1, 7))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("symbol", "date")
        .agg(
            F.sum(whole("l_discount")).alias("sd"), F.count("*").alias("n"), F.max(whole("l_tax")).alias("tx"), F.min(whole("l_tax")).alias("tn"),
            F.sum(F.col("l_quantity").cast("long")).cast("double").alias("volume"),
        )
    )
    w = W.partitionBy("symbol").orderBy("date")
    number = lambda x: F.lit(x).cast("double")
    step = number(0.5) * (F.col("sd").cast("double") - number(5.0) * F.col("n")) / number(100.0) / F.sqrt(F.col("n").cast("double"))
    raw = number(100.0) * F.exp(F.sum(step).over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = days.withColumn("raw", raw).select(
        "symbol", "date", "volume",
        F.round("raw", 4).alias("close"),
        F.round(F.col("raw") * (number(1.0) + (1 + F.col("tx")) / number(800.0)), 4).alias("high"),
        F.round(F.col("raw") * (number(1.0) - (1 + F.col("tn") + F.col("tx")) / number(1600.0)), 4).alias("low"),
    )
    return out.select("symbol", "date", F.coalesce(F.lag("close").over(w), "close").alias("open"), "high", "low", "close", "volume")


#: The same bars in DuckDB's SQL, as CTEs to put in front of a query.
SQL = """
days as (
  select p_type as symbol, cast(l_shipdate as date) as date, cast(sum(cast(round(l_discount * 100) as bigint)) as bigint) as sd, count(*) as n,
    max(cast(round(l_tax * 100) as bigint)) as tx, min(cast(round(l_tax * 100) as bigint)) as tn, cast(sum(cast(l_quantity as bigint)) as double) as volume
  from lineitem join part on l_partkey = p_partkey where dayofweek(cast(l_shipdate as date)) not in (0, 6) group by 1, 2),
raws as (
  select *, cast(100.0 as double) * exp(sum(cast(0.5 as double) * (cast(sd as double) - cast(5.0 as double) * n) / cast(100.0 as double) / sqrt(cast(n as double)))
    over (partition by symbol order by date rows unbounded preceding)) as raw from days),
closes as (
  select symbol, date, round(raw, 4) as close, round(raw * (cast(1.0 as double) + (1 + tx) / cast(800.0 as double)), 4) as high,
    round(raw * (cast(1.0 as double) - (1 + tn + tx) / cast(1600.0 as double)), 4) as low, volume from raws),
bars as (
  select symbol, date, coalesce(lag(close) over (partition by symbol order by date), close) as open, high, low, close, volume,
    row_number() over (partition by symbol order by date) - 1 as rn from closes),
weekly as (
  select symbol, week as date, arg_min(open, date) as open, max(high) as high, min(low) as low, arg_max(close, date) as close, sum(volume) as volume
  from (select *, cast(date + cast((5 - dayofweek(date) + 7) % 7 as integer) as date) as week from bars) group by symbol, week),
weeks as (select *, row_number() over (partition by symbol order by date) - 1 as rn from weekly)"""

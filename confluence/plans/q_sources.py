"""Queries over the library's own file formats: what is written from the tape is read back through them."""

from __future__ import annotations

from pyspark.sql import functions as F

from confluence.plans.catalog import query
from confluence.plans.q_series import WITH
from confluence.sources import scratch, symbol_files, tape

FROM, TO = "1995-03-01", "1996-09-30"


def price_files(spark, sf_dir):
    """The tape as CSV files, one a symbol, written once for a session."""
    return scratch.once(spark, "price_files", sf_dir, lambda path: symbol_files.write_series(tape.bars(spark, sf_dir), path))


def between(df):
    return df.filter((F.col("date") >= F.lit(FROM).cast("date")) & (F.col("date") <= F.lit(TO).cast("date")))


@query(f"{WITH} select symbol, date, open, high, low, close, volume from bars where date between '{FROM}' and '{TO}'")
def source_scan(spark, sf_dir):
    """A range of days from the files of all symbols; the range is pushed to the readers."""
    return between(symbol_files.scan(spark, price_files(spark, sf_dir)))


@query(f"{WITH} select symbol, date, open, high, low, close, volume from weekly where symbol in (select min(symbol) from bars union select max(symbol) from bars)")
def source_scan_weeks(spark, sf_dir):
    """Weeks of two symbols: only their files are read."""
    path = price_files(spark, sf_dir)
    ends = tape.read(spark, sf_dir, "part").agg(F.min("p_type").alias("a"), F.max("p_type").alias("b")).first()
    return symbol_files.scan(spark, path, interval="1wk").filter(F.col("symbol").isin(ends.a, ends.b))


@query(f"""{WITH} select symbol, last_day(date) as date, arg_min(open, date) as open, max(high) as high, min(low) as low, arg_max(close, date) as close, sum(volume) as volume
from bars group by symbol, last_day(date)""")
def source_scan_months(spark, sf_dir):
    return symbol_files.scan(spark, price_files(spark, sf_dir), interval="1mo")

"""Event windows: earnings, ex-dividend days and macro releases of the next weeks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluence import config as C
from confluence.operators.report import format_price

JURISDICTIONS = {"fomc": "US", "cpi": "US", "ppi": "US", "nfp": "US", "gdp": "US", "other": "—"}


def within(days: Column, most: int = C.EVENT_DAYS) -> Column:
    return F.coalesce(days.between(0, most), F.lit(False))


def macro_window(macro: DataFrame, today: Column, most: int = C.EVENT_DAYS) -> DataFrame:
    """Releases from today on, at most so many days ahead, with ``days_until``."""
    return macro.withColumn("days_until", F.datediff("date", today)).filter(within(F.col("days_until"), most))


def macro_banner(macro: DataFrame, today: Column) -> DataFrame:
    """date, days_until, kind (upper case), jurisdiction, description of coming releases."""
    table = F.create_map(*[F.lit(x) for pair in JURISDICTIONS.items() for x in pair])
    return macro_window(macro, today).select("date", "days_until", F.upper("kind").alias("kind"), F.coalesce(F.try_element_at(table, F.col("kind")), F.lit("—")).alias("jurisdiction"), "description").orderBy("date", "kind")


def as_json(macro: DataFrame) -> Column:
    """An aggregate: releases as a JSON list, by date and kind."""
    item = F.struct(macro["date"], macro["kind"], macro["description"])
    return F.to_json(F.array_sort(F.collect_list(item)))


def binary_events(candidates: DataFrame, earnings: DataFrame, dividends: DataFrame, macro: DataFrame, today: Column) -> DataFrame:
    """One row per candidate: next earnings and ex-dividend days, whether they are near, macro releases near, flags.

    A date in the past keeps its negative days but isn't near.  Macro releases count for every candidate and aren't flags.
    A dividend is said in the candidate's ``currency``, dollars where that is null or missing.
    """
    count = macro_window(macro, today).agg(F.count("*").alias("macro_count"), F.array_join(F.array_sort(F.collect_set("kind")), ", ").alias("macro_kinds"))  # one row
    df = candidates.join(earnings.select("symbol", F.col("date").alias("earnings_date")), "symbol", "left")
    df = df.join(dividends.select("symbol", F.col("date").alias("ex_div_date"), F.col("amount").alias("ex_div_amount")), "symbol", "left")
    df = df.crossJoin(F.broadcast(count)).withColumns({"days_to_earnings": F.datediff("earnings_date", today), "days_to_ex_div": F.datediff("ex_div_date", today)})
    df = df.withColumns({"earnings_near": within(F.col("days_to_earnings")), "ex_div_near": within(F.col("days_to_ex_div")), "macro_near": F.col("macro_count") > 0})
    say = lambda head, days: F.concat(F.lit(f"{head} en "), days.cast("string"), F.lit(" días"))
    behind = lambda text: F.concat(F.lit(" ("), text, F.lit(")"))
    currency = F.col("currency") if "currency" in candidates.columns else F.lit("USD")
    flags = F.array_compact(F.array(
        F.when(F.col("earnings_near"), F.concat(say("Earnings", F.col("days_to_earnings")), behind(F.col("earnings_date").cast("string")))),
        F.when(F.col("ex_div_near"), F.concat(say("Ex-dividend", F.col("days_to_ex_div")), F.coalesce(behind(format_price(F.col("ex_div_amount"), currency)), F.lit("")))),
    ))
    return df.withColumns({"has_events": F.col("earnings_near") | F.col("ex_div_near") | F.col("macro_near"), "flags": F.array_join(flags, " | ")})

"""Typed projections of raw source frames: cleaners, rating actions, period picks, latest values, events ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Rating actions as sources name them, periods in order of preference, opinion counts, and the sources of each entity in order.
ACTIONS = {"down": "downgrade", "init": "initiation", "main": "reiterated", "reit": "reiterated", "up": "upgrade"}
PERIODS = ("0m", "-1m")
COUNTS = ("strong_buy", "buy", "hold", "sell", "strong_sell")
SOURCES = {
    "analyst": ("primary", "fallback"), "bars": ("primary",), "dividends": ("primary",), "earnings": ("primary", "fallback"), "earnings_history": ("primary",),
    "financials": ("primary",), "profile": ("primary", "fallback"), "ratings": ("primary",),
}


def clean_text(value: Column) -> Column:
    """A text; null for empty ones."""
    return F.nullif(value.cast("string"), F.lit(""))


def clean_number(value: Column) -> Column:
    """A double; null for what is no number, NaN included."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def clean_count(value: Column) -> Column:
    """A whole number, decimals cut; 0 for what is none."""
    return F.coalesce(clean_number(value).cast("long"), F.lit(0).cast("long"))


def clean_date(value: Column) -> Column:
    """A date from an ISO date or time; null for what is none."""
    return F.try_to_date(F.substring(value.cast("string"), 1, 10), "yyyy-MM-dd")


def rating_action(action: Column, keep_case: bool = False) -> Column:
    """A source's action by its usual name; others in lower case (or as they are), empty and null ones empty."""
    key = F.lower(F.trim(action))
    known = F.try_element_at(F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair]), key)
    return F.coalesce(known, action if keep_case else key, F.lit(""))


def recommendation_counts(rows: DataFrame, key: str = "symbol") -> DataFrame:
    """(key, COUNTS): the counts of the first period of PERIODS that a symbol has; zeros where it has neither."""
    rank = F.array_position(F.array(*[F.lit(p) for p in PERIODS]), F.col("period"))
    best = F.min_by(F.struct(*[clean_count(F.col(c)).alias(c) for c in COUNTS]), F.when(rank > 0, rank))
    return rows.groupBy(key).agg(best.alias("_best")).select(key, *[F.coalesce(F.col(f"_best.{c}"), F.lit(0).cast("long")).alias(c) for c in COUNTS])


def recommendation_mean(counts: list[Column]) -> Column:
    """1 (strong buy) to 5 (strong sell); null without opinions."""
    total = sum(counts[1:], counts[0])
    return F.when(total > 0, sum((c * (i + 2) for i, c in enumerate(counts[1:])), counts[0] * 1) / F.nullif(total, F.lit(0)))


def latest_values(rows: DataFrame, labels: tuple[str, ...], key: str = "symbol") -> DataFrame:
    """(key, a column for each label): the newest value of each line of a statement (key, label, date, value); null if that isn't a number."""
    newest = [F.max(F.when(F.col("label") == n, F.struct("date", clean_number(F.col("value")).alias("value")))).getField("value").alias(n) for n in labels]
    return rows.groupBy(key).agg(*newest)


def upcoming(events: DataFrame, today: Column, days: int, key: str = "symbol") -> DataFrame:
    """(key, date): the earliest date from today on, at most so many days ahead."""
    return events.filter(F.datediff("date", today).between(0, days)).groupBy(key).agg(F.min("date").alias("date"))


def last_dividend(dividends: DataFrame, key: str = "symbol") -> DataFrame:
    """(key, amount): the newest dividend; of those of one day the largest."""
    return dividends.groupBy(key).agg(F.max(F.struct("date", "amount")).getField("amount").alias("amount"))


def profile(raw: DataFrame, in_millions: bool = False) -> DataFrame:
    """symbol, name, sector, country, market_cap of raw profiles; without a name of its own a symbol has none."""
    cap = clean_number(F.col("market_cap")) * (1e6 if in_millions else 1.0)
    name = F.coalesce(clean_text(F.col("long_name")), clean_text(F.col("short_name")))
    return raw.select("symbol", name.alias("name"), clean_text(F.col("sector")).alias("sector"), clean_text(F.col("country")).alias("country"), cap.alias("market_cap")).filter("name <> symbol")


def from_cache(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Typed rows from a cache's JSON lines; broken lines are left out."""
    return lines.select(F.from_json(column, schema).alias("_row"), F.col(column).alias("_line")).filter("_row is not null and try_parse_json(_line) is not null").select("_row.*")


def newest_files(rows: DataFrame, keys: list[str], changed: str = "changed") -> DataFrame:
    """The row of the newest file for each key."""
    order = W.partitionBy(*keys).orderBy(F.desc(changed))
    return rows.withColumn("_pick", F.row_number().over(order)).filter("_pick = 1").drop("_pick")

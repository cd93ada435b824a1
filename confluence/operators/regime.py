"""Regimes, triggers and the classification that joins them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confluence import config as C
from confluence.functions import series as S

# Labels of a report, and the first generation's types: fixed values.
REGIME_LABELS = {"downtrend": "Downtrend", "lateral": "Lateral", "reversal": "Reversal", "uptrend": "Uptrend"}
TRIGGER_LABELS = {
    "capitulation_reclaim": "Capitulación con reclaim", "double_bottom_confirmed": "Doble piso confirmado", "double_bottom_unconfirmed": "Doble piso en formación",
    "hma_weekly_flip": "Cambio de régimen", "post_earnings_dip": "Dip post-earnings", "pullback_in_uptrend": "Pullback en tendencia", "range_floor": "Piso de rango",
}
DIVERGENCE_LABEL, NO_TRIGGER = "divergencia", "sin trigger"
LEGACY = {
    "capitulation_reclaim": "T2", "double_bottom_confirmed": "T2", "double_bottom_unconfirmed": "T2", "hma_weekly_flip": "T2", "post_earnings_dip": "T4",
    "pullback_in_uptrend": "T1", "range_floor": "T3",
}


def ranges(bars: DataFrame, n: int = C.REGIME_BARS) -> DataFrame:
    """symbol, top_price, floor_price, mean_price, n: closes' spread over the last n bars."""
    own = bars.filter(F.col("rn") > F.col("top") - n)
    return own.groupBy("symbol").agg(F.max("high").alias("top_price"), F.min("low").alias("floor_price"), F.avg("close").alias("mean_price"), F.max("close").alias("top_close"), F.min("close").alias("floor_close"), F.count("*").alias("n"), F.first("spot").alias("spot"))


def regimes(bars: DataFrame, weeks: DataFrame, flips: DataFrame) -> DataFrame:
    """symbol, regime.  A fresh weekly flip with the close above it is a reversal; without both weekly averages it
    is a downtrend; near averages in a narrow range are lateral; else the averages' order decides."""
    week = S.last_rows(weeks.withColumns({"a": S.sma(F.col("close"), 50), "b": S.sma(F.col("close"), 200)})).select("symbol", "a", "b")
    df = week.join(ranges(bars), "symbol").join(flips, "symbol", "left")
    near = F.abs(F.col("a") - F.col("b")) / F.col("b") < C.REGIME_TOLERANCE
    narrow = (F.col("top_price") - F.col("floor_price")) / F.col("floor_price") < C.REGIME_RANGE
    regime = (
        F.when(F.coalesce(F.col("valid") & F.col("close_above"), F.lit(False)), "reversal")
        .when(F.col("a").isNull() | F.col("b").isNull(), "downtrend")
        .when((F.col("n") >= C.REGIME_BARS) & near & narrow, "lateral")
        .when(F.col("a") > F.col("b"), "uptrend")
        .otherwise("downtrend")
    )
    return df.select("symbol", regime.alias("regime"))


def range_floor(bars: DataFrame) -> DataFrame:
    """symbol, position: closes in the lowest third of 60 bars' range."""
    own = ranges(bars, C.RANGE_FLOOR_BARS).filter(F.col("n") >= C.RANGE_FLOOR_BARS)
    span = F.col("top_price") - F.col("floor_price")
    return own.filter(F.col("spot") < F.col("floor_price") + C.RANGE_FLOOR * span).select("symbol", F.try_divide(F.col("spot") - F.col("floor_price"), span).alias("position"))


def post_earnings_dip(bars: DataFrame, earnings: DataFrame, dip: float = C.DIP, upcoming: DataFrame | None = None) -> DataFrame:
    """symbol, event, change: the close two bars after the last earnings of 60 calendar days against the last one before.

    Symbols of ``upcoming``, whose next earnings are near, are left out.
    """
    if upcoming is not None:
        earnings = earnings.join(upcoming.select("symbol").distinct(), "symbol", "left_anti")
    top = S.last_rows(bars).select("symbol", F.col("date").alias("today"))
    last = earnings.join(top, "symbol").filter((F.col("date") <= F.col("today")) & (F.col("date") >= F.date_sub("today", C.DIP_DAYS))).groupBy("symbol").agg(F.max("date").alias("event"))
    own = bars.select("symbol", "date", "close").join(last, "symbol")
    before = own.filter("date < event").groupBy("symbol", "event").agg(F.max_by("close", "date").alias("before"))
    order = W.partitionBy("symbol").orderBy("date")
    after = own.filter("date > event").withColumn("k", F.row_number().over(order)).filter(F.col("k") == C.DIP_BARS).select("symbol", F.col("close").alias("after"))
    change = F.col("after") / F.col("before") - 1
    return before.join(after, "symbol").withColumn("change", change).filter(F.col("change") <= dip).select("symbol", "event", "change")


def divergence(bars: DataFrame, found: DataFrame) -> DataFrame:
    """symbol, p1, p2, rsi1, rsi2: the last two pivot lows of 60 calendar days, price lower and RSI higher, below 45."""
    top = bars.groupBy("symbol").agg(F.max("date").alias("today"))
    lows = found.filter("kind = 'low'").join(top, "symbol").filter(F.col("date") >= F.date_sub("today", C.DIVERGENCE_DAYS)).select("symbol", "rn", "price", "rsi")
    order = W.partitionBy("symbol").orderBy(F.desc("rn"))
    two = lows.withColumn("back", F.row_number().over(order)).filter("back <= 2")
    side = lambda c, k: F.max(F.when(F.col("back") == k, F.col(c)))
    pair = two.groupBy("symbol").agg(side("price", 2).alias("p1"), side("price", 1).alias("p2"), side("rsi", 2).alias("rsi1"), side("rsi", 1).alias("rsi2"))
    return pair.filter((F.col("p2") < F.col("p1")) & (F.col("rsi2") > F.col("rsi1")) & (F.col("rsi2") < C.DIVERGENCE_RSI))


def classified(facts: DataFrame) -> DataFrame:
    """symbol, regime, triggers, primary_trigger, legacy, label.

    ``facts``: symbol, regime and a boolean for each name of ``C.TRIGGERS``.  Triggers count where their regime fits, heaviest
    first; the primary one has the largest positive weight, ties by order of evaluation.
    """
    hits = F.array_compact(
        F.array(*[
            F.when(F.coalesce(F.col(name), F.lit(False)) & F.col("regime").isin(*fit), F.struct(F.lit(-weight).alias("minus"), F.lit(i).alias("ord"), F.lit(name).alias("name")))
            for i, (name, weight, fit) in enumerate(C.TRIGGERS)
        ])
    )
    df = facts.withColumn("hits", F.array_sort(hits))
    first = F.when((F.size("hits") > 0) & (F.try_element_at("hits", F.lit(1))["minus"] < 0), F.try_element_at("hits", F.lit(1))["name"])
    df = df.withColumns({"triggers": F.transform("hits", lambda h: h["name"]), "primary_trigger": first})
    return df.select("symbol", "regime", F.array_join("triggers", "|").alias("triggers"), "primary_trigger", _mapped(LEGACY, F.col("primary_trigger")).alias("legacy"), label().alias("label"))


def trigger_facts(regimes: DataFrame, found: list[DataFrame]) -> DataFrame:
    """symbol, trigger, fact, value: the numbers behind each trigger whose regime fits.

    ``found``: frames of symbol, trigger and numeric columns.
    """
    parts = []
    for df in found:
        facts = [F.struct(F.lit(c).alias("fact"), F.col(c).cast("double").alias("value")) for c in df.columns if c not in ("symbol", "trigger")]
        parts.append(df.select("symbol", "trigger", F.inline(F.array(*facts))))
    fits = F.create_map(*[x for name, _, fit in C.TRIGGERS for x in (F.lit(name), F.array(*[F.lit(r) for r in fit]))])
    every = reduce(DataFrame.unionByName, parts).join(regimes, "symbol")
    return every.filter(F.array_contains(F.element_at(fits, F.col("trigger")), F.col("regime"))).select("symbol", "trigger", "fact", "value")


def _mapped(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def label() -> Column:
    """A composite label: regime, primary trigger, and whether a divergence adds to it."""
    lead = F.concat(F.coalesce(_mapped(REGIME_LABELS, F.col("regime")), F.col("regime")), F.lit(": "))
    extra = F.when(F.array_contains("triggers", "bullish_divergence"), F.lit(f" + {DIVERGENCE_LABEL}")).otherwise("")
    named = F.coalesce(_mapped(TRIGGER_LABELS, F.col("primary_trigger")), F.col("primary_trigger"))
    return F.concat(lead, F.coalesce(F.concat(named, extra), F.lit(NO_TRIGGER)))

"""Levels and zones as of many days of a series in one pass, and how often zones have held.

A day's levels depend on the year before it.  Smoothed series and pivots look back only, so they are computed once for the
whole series; what a pivot or a bar adds to later days is sent to those days (``reach``), and then every level
generator works on (symbol, day) as it does on a symbol.  A pivot is known PIVOT_REACH bars after its own.  Long
series spread over tasks by day.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confluence import config as C
from confluence.functions import series as S
from confluence.functions import strikes as K
from confluence.operators import levels as L
from confluence.operators import profile as V
from confluence.operators import zones as Z

#: Bars within which a zone must hold: three weeks.
HORIZON = 15


def is_day(rn: Column, step: int) -> Column:
    """Every ``step``-th bar."""
    return rn % step == step - 1


def named(symbol: Column | str = "symbol", at: Column | str = "at") -> Column:
    """The name of a symbol's series as of a bar."""
    return F.concat_ws("@", symbol, at)


def days(bars: DataFrame, step: int) -> DataFrame:
    """symbol, at, day, spot, last_atr of every step-th bar."""
    return bars.filter(is_day(F.col("rn"), step)).select("symbol", F.col("rn").alias("at"), F.col("date").alias("day"), F.col("close").alias("spot"), F.col("atr").alias("last_atr"))


def reach(rows: DataFrame, on: DataFrame, step: int, after: int = 0, window: int = C.LEVEL_WINDOW) -> DataFrame:
    """``rows`` once for each day from ``after`` bars behind them on in whose window they are; symbol is the day's series then."""
    rn = F.col("rn").cast("int")
    first = rn + after + (step - 1 - (rn + after) % step)
    last = rn + window - 1
    each = rows.drop("top", "spot", "last_atr").withColumn("at", F.explode(F.when(first <= last, F.sequence(first, last, F.lit(step)))))
    return each.join(on.select("symbol", "at", "spot", "last_atr"), ["symbol", "at"]).withColumn("symbol", named()).withColumnRenamed("at", "top")


def averages(bars: DataFrame, weeks: DataFrame, step: int) -> DataFrame:
    """The moving averages of each day; the running week counts with the day's close."""
    day = bars.withColumns({"sma_200d": S.sma(F.col("close"), 200), "sma_50d": S.sma(F.col("close"), 50)} | {f"ema_{n}d": F.when(F.col("rn") >= n - 1, S.ewm(F.col("close"), 2.0 / (n + 1))) for n in (200, 50)})
    day = day.filter(is_day(F.col("rn"), step)).withColumn("week", F.next_day(F.date_sub("date", 1), "FRI"))
    past = lambda n: S.by().rowsBetween(-(n - 1), -1)
    before = weeks.select("symbol", F.col("date").alias("week"), *[F.when(F.count("close").over(past(n)) == n - 1, F.sum("close").over(past(n))).alias(f"before_{n}") for n in (200, 50)])
    names = ("sma_200w", "ema_200d", "sma_200d", "sma_50d", "sma_50w", "ema_50d")
    wide = day.join(before, ["symbol", "week"]).withColumns({f"sma_{n}w": (F.col(f"before_{n}") + F.col("close")) / n for n in (200, 50)})
    rows = F.inline(F.array(*[F.struct(F.lit(n).alias("element"), F.col(n).alias("price")) for n in names]))
    return wide.select(named(at="rn").alias("symbol"), F.col("close").alias("spot"), F.col("atr").alias("last_atr"), F.col("rn").cast("long").alias("rn"), F.lit(None).cast("string").alias("detail"), rows).filter("price is not null").select(L.COLUMNS)


def last_events(on: DataFrame, events: DataFrame) -> DataFrame:
    """(symbol, date): the newest event up to each day, under the day's series."""
    both = on.select("symbol", "day", "at", F.lit(None).cast("date").alias("event")).unionByName(events.select("symbol", F.col("date").alias("day"), F.lit(None).cast("int").alias("at"), F.col("date").alias("event")))
    order = W.partitionBy("symbol").orderBy("day", F.col("at").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("event", F.last("event", ignorenulls=True).over(order)).filter("at is not null and event is not null").select(named().alias("symbol"), F.col("event").alias("date"))


def levels(bars: DataFrame, weeks: DataFrame, found: DataFrame, step: int, events: DataFrame | None = None) -> DataFrame:
    """All levels as of every step-th bar (columns as in ``levels.COLUMNS``, and side); symbol is ``named``.

    ``bars`` has rn, atr, rsi and macd_hist, ``found`` the accepted pivots of the whole series.
    """
    on = days(bars, step)
    own = reach(bars.select("symbol", "date", "rn", "high", "low", "close", "volume"), on, step)
    pivots = reach(found, on, step, after=C.PIVOT_REACH)
    nodes = V.node_levels(V.sliding(bars).filter(is_day(F.col("rn"), step)).withColumn("symbol", named(at="rn")))
    nodes = nodes.drop("date", "last_atr").join(on.select(named().alias("symbol"), "last_atr"), "symbol").select(L.COLUMNS)
    starts = L.anchors(pivots, own, None if events is None else last_events(on, events))
    parts = (averages(bars, weeks, step), L.polarity(pivots), L.fibonacci(pivots), L.anchored_vwap(starts, own), nodes, L.gaps(own), L.divergences(pivots))
    out = reduce(lambda a, b: a.unionByName(b), [p.select(L.COLUMNS) for p in parts])
    return out.withColumn("side", F.when(F.col("price") < F.col("spot"), "support").otherwise("resistance"))


def zones(bars: DataFrame, weeks: DataFrame, found: DataFrame, step: int, events: DataFrame | None = None) -> DataFrame:
    """Zones as of every step-th bar: the columns of ``zones.zones``, with symbol and ``at`` apart."""
    z = Z.zones(Z.clustered(levels(bars, weeks, found, step, events)))
    return z.withColumns({"at": F.substring_index("symbol", "@", -1).cast("int"), "symbol": F.expr("substring(symbol, 1, length(symbol) - length(substring_index(symbol, '@', -1)) - 1)")})


def outcomes(z: DataFrame, bars: DataFrame, horizon: int = HORIZON, currency: str = "USD") -> DataFrame:
    """symbol, at, date, tier, score, strike, lowest, held of each day's best zone: whether no low of the next ``horizon`` bars
    lies below its conservative strike.  Days with fewer bars behind them are left out."""
    ahead = S.by().rowsBetween(1, horizon)
    low = bars.select("symbol", F.col("rn").alias("at"), "date", F.min("low").over(ahead).alias("lowest"), F.count("low").over(ahead).alias("n")).filter(F.col("n") == horizon).drop("n")
    strike = K.strikes(*[F.col(c) for c in ("lower", "upper", "center", "spot", "atr")], F.lit(currency))["strike_conservative"]
    best = Z.best(z).select("symbol", "at", "tier", "score", strike.alias("strike"))
    return best.join(low, ["symbol", "at"]).select("symbol", "at", "date", "tier", "score", "strike", "lowest", (F.col("lowest") >= F.col("strike")).alias("held"))


def hold_rate(found: DataFrame) -> DataFrame:
    """tier, n, n_held, rate of ``outcomes``; a null tier stands for all."""
    return found.rollup("tier").agg(F.count("*").alias("n"), F.count_if("held").alias("n_held")).withColumn("rate", F.col("n_held") / F.col("n"))

"""Support levels: generators from bars to COLUMNS; rn is the bar that a level comes from, detail says more about it.

``bars`` has rn, the oscillators and what ``context`` adds; pivots carry that on.  Days are bars here.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confluence import config as C
from confluence.functions import series as S

COLUMNS = ["symbol", "element", "price", "rn", "detail", "spot", "last_atr"]


def context(bars: DataFrame) -> DataFrame:
    """Adds the last bar's ``top`` (rn), ``spot`` (close) and ``last_atr``."""
    whole = W.partitionBy("symbol")
    atr = F.max_by("atr", "rn").over(whole) if "atr" in bars.columns else F.lit(None).cast("double")
    return bars.withColumns({"top": F.max("rn").over(whole), "spot": F.max_by("close", "rn").over(whole), "last_atr": atr})


def _recent(n: int) -> Column:
    return F.col("rn") > F.col("top") - n


def _level(element: Column | str, price: Column, rn: Column | str, detail: Column) -> list[Column]:
    element = element if isinstance(element, Column) else F.lit(element)
    rn = rn if isinstance(rn, Column) else F.col(rn)
    return [F.col("symbol"), element.alias("element"), price.alias("price"), rn.cast("long").alias("rn"), detail.cast("string").alias("detail"), F.col("spot"), F.col("last_atr")]


def moving_averages(bars: DataFrame, weeks: DataFrame) -> DataFrame:
    """Averages of the last bar; those of short series are left out."""
    day = bars.withColumns({"sma_200d": S.sma(F.col("close"), 200), "sma_50d": S.sma(F.col("close"), 50), "ema_200d": S.ema(F.col("close"), 200), "ema_50d": S.ema(F.col("close"), 50)}).filter("rn = top")
    week = S.last_rows(weeks.select("symbol", "date", S.sma(F.col("close"), 200).alias("sma_200w"), S.sma(F.col("close"), 50).alias("sma_50w"))).drop("date")
    names = ("sma_200w", "ema_200d", "sma_200d", "sma_50d", "sma_50w", "ema_50d")
    rows = F.inline(F.array(*[F.struct(F.lit(n).alias("element"), F.col(n).alias("price")) for n in names]))
    every = day.join(week, "symbol", "left").select("symbol", F.col("rn").alias("at"), "spot", "last_atr", rows).filter("price is not null")
    return every.select(*_level(F.col("element"), F.col("price"), "at", F.lit(None)))


def polarity(found: DataFrame) -> DataFrame:
    """Pivot highs of the last year that price has left above itself; detail: their day."""
    return found.filter((F.col("kind") == "high") & _recent(C.LEVEL_WINDOW) & (F.col("price") < F.col("spot"))).select(*_level("polarity", F.col("price"), "rn", F.col("date")))


def fibonacci(found: DataFrame) -> DataFrame:
    """Retracements from the last pivot low of the year to the last later pivot high, or to the last close; detail: the low's day."""
    last = lambda kind: F.max(F.when(F.col("kind") == kind, F.struct("rn", "price", "date")))
    both = found.filter(_recent(C.LEVEL_WINDOW)).groupBy("symbol", "spot", "last_atr").agg(last("low").alias("low"), last("high").alias("high")).filter("low is not null")
    high, low = F.when(F.col("high.rn") > F.col("low.rn"), F.col("high.price")).otherwise(F.col("spot")), F.col("low.price")
    rows = F.inline(F.array(*[F.struct(F.lit(n).alias("element"), (high - F.lit(r) * (high - low)).alias("price")) for n, r in C.FIBONACCI]))
    every = both.filter(F.coalesce(high > low, F.lit(False))).select("symbol", "spot", "last_atr", F.col("low.rn").alias("at"), F.col("low.date").alias("day"), rows)
    return every.select(*_level(F.col("element"), F.col("price"), "at", F.col("day")))


def anchors(found: DataFrame, bars: DataFrame, earnings: DataFrame | None = None) -> DataFrame:
    """(symbol, element, anchor): the bars of the last year that anchored volume-weighted prices start from."""
    low = found.filter((F.col("kind") == "low") & _recent(C.LEVEL_WINDOW)).groupBy("symbol").agg(F.max("rn").alias("anchor")).select("symbol", F.lit("avwap_pivot_low").alias("element"), "anchor")
    year = bars.filter(_recent(C.LEVEL_WINDOW))
    high = year.filter(F.col("top") >= C.LEVEL_WINDOW - 1).groupBy("symbol").agg(F.max_by("rn", F.struct("high", -F.col("rn"))).alias("anchor")).select("symbol", F.lit("avwap_52w_high").alias("element"), "anchor")
    out = low.unionByName(high)
    if earnings is not None:  # the first bar from the last earnings on, which must lie in the year
        last = earnings.groupBy("symbol").agg(F.max("date").alias("event"))
        first = year.join(last, "symbol").groupBy("symbol").agg(F.min("date").alias("from"), F.first("event").alias("event"), F.min(F.when(F.col("date") >= F.col("event"), F.col("rn"))).alias("anchor"))
        out = out.unionByName(first.filter("event >= `from` and anchor is not null").select("symbol", F.lit("avwap_earnings").alias("element"), "anchor"))
    return out


def anchored_vwap(starts: DataFrame, bars: DataFrame) -> DataFrame:
    """Volume-weighted typical prices from each anchor to the last bar; detail: the anchor's day."""
    mid = (F.col("high") + F.col("low") + F.col("close")) / 3
    year = bars.filter(_recent(C.LEVEL_WINDOW))
    own = year.select("symbol", "date", "rn", "spot", "last_atr", "volume", (mid * F.col("volume")).alias("flow")).join(starts, "symbol").filter("rn >= anchor")
    price = F.when(F.sum("volume") > 0, F.sum("flow") / F.nullif(F.sum("volume"), F.lit(0.0)))
    every = own.groupBy("symbol", "element").agg(price.alias("price"), F.first("anchor").alias("at"), F.min("date").alias("day"), F.first("spot").alias("spot"), F.first("last_atr").alias("last_atr"))
    return every.filter("price is not null").select(*_level(F.col("element"), F.col("price"), "at", F.col("day")))


def volume_profile(bars: DataFrame) -> DataFrame:
    """symbol, bucket, low_price, width, volume: a year's volume over 50 equal price buckets, by overlap; empty ones too.

    Series of less than a year have no profile.
    """
    year = bars.filter(_recent(C.LEVEL_WINDOW) & (F.col("top") >= C.LEVEL_WINDOW - 1))
    whole = W.partitionBy("symbol")
    spread = year.withColumns({"bottom": F.min("low").over(whole), "width": (F.max("high").over(whole) - F.min("low").over(whole)) / C.HVN_BUCKETS}).filter("width > 0")
    place = lambda x: F.greatest(F.lit(0), F.least(F.lit(C.HVN_BUCKETS - 1), F.floor((x - F.col("bottom")) / F.col("width")).cast("int")))
    span = F.col("high") - F.col("low")
    dealt = spread.withColumn("bucket", F.explode(F.when(span <= 0, F.array(place(F.col("close")))).otherwise(F.sequence(place(F.col("low")), place(F.col("high"))))))
    left = F.col("bottom") + F.col("bucket") * F.col("width")
    overlap = F.least(F.col("high"), left + F.col("width")) - F.greatest(F.col("low"), left)
    share = F.when(span <= 0, F.col("volume")).otherwise(F.greatest(overlap, F.lit(0.0)) / F.nullif(span, F.lit(0.0)) * F.col("volume"))
    some = dealt.groupBy("symbol", "bucket").agg(F.sum(share).alias("volume"))
    kept = [F.first(c).alias(c) for c in ("bottom", "width", "spot", "last_atr")]
    every = spread.groupBy("symbol").agg(*kept).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(C.HVN_BUCKETS - 1))))
    return every.join(some, ["symbol", "bucket"], "left").select("symbol", "bucket", (F.col("bottom") + F.col("bucket") * F.col("width")).alias("low_price"), "width", F.coalesce("volume", F.lit(0.0)).alias("volume"), "spot", "last_atr")


def volume_nodes(profile: DataFrame) -> DataFrame:
    """Runs of neighbouring buckets at or above the 80th percentile; a run's price is its middle.  rn: its first bucket; detail: first-last."""
    dense = profile.withColumn("edge", F.percentile("volume", F.lit(C.HVN_PERCENTILE)).over(W.partitionBy("symbol"))).filter(F.col("volume") >= F.col("edge"))
    run = F.col("bucket") - F.row_number().over(W.partitionBy("symbol").orderBy("bucket"))
    islands = dense.withColumn("run", run).groupBy("symbol", "run", "spot", "last_atr").agg(
        F.min("low_price").alias("a"), F.max(F.col("low_price") + F.col("width")).alias("b"), F.min("bucket").alias("from"), F.max("bucket").alias("to")
    )
    return islands.select(*_level("hvn", (F.col("a") + F.col("b")) / 2, "from", F.concat_ws("-", F.col("from").cast("string"), F.col("to").cast("string"))))


def gaps(bars: DataFrame) -> DataFrame:
    """Up-gaps between two bars of the last year that no later low has closed, at their middle; detail: their day."""
    before = F.lag("high").over(S.by())
    later = F.min("low").over(S.by().rowsBetween(1, W.unboundedFollowing))
    found = bars.withColumns({"floor": before, "later": later}).filter(_recent(C.LEVEL_WINDOW - 1) & (F.col("low") > F.col("floor")) & (F.col("later").isNull() | (F.col("later") > F.col("floor"))))
    return found.select(*_level("gap_unfilled", (F.col("floor") + F.col("low")) / 2, "rn", F.col("date")))


def divergences(found: DataFrame) -> DataFrame:
    """The last pivot low where price fell from the one before and RSI or the MACD histogram rose (60 bars); detail: rsi, macd or both."""
    lows = found.filter((F.col("kind") == "low") & _recent(C.DIVERGENCE_BARS)).groupBy("symbol", "spot", "last_atr")
    pair = lows.agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("rn", "price", "rsi", "macd_hist")))), 1, 2).alias("two")).filter("size(two) = 2")
    now, past = F.get("two", F.lit(0)), F.get("two", F.lit(1))
    rises = lambda c: F.coalesce(now[c] > past[c], F.lit(False))
    which = F.when(rises("rsi") & rises("macd_hist"), "both").when(rises("rsi"), "rsi").when(rises("macd_hist"), "macd")
    return pair.withColumn("which", which).filter((now["price"] < past["price"]) & F.col("which").isNotNull()).select(*_level("divergence", now["price"], now["rn"], F.col("which")))


EXTRA: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}


def register_level(name: str, generator: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """Adds a generator (pivots, bars) -> levels to ``all_levels``."""
    EXTRA[name] = generator


def all_levels(bars: DataFrame, weeks: DataFrame, found: DataFrame, earnings: DataFrame | None = None) -> DataFrame:
    """All levels with ``side``: support where the price is below the last close.

    Pivots and bars carry the last bar's facts, so generators don't look those up.
    """
    parts = [
        moving_averages(bars, weeks), polarity(found), fibonacci(found), anchored_vwap(anchors(found, bars, earnings), bars),
        volume_nodes(volume_profile(bars)), gaps(bars), divergences(found), *(g(found, bars) for g in EXTRA.values()),
    ]
    out = reduce(lambda a, b: a.unionByName(b), [p.select(COLUMNS) for p in parts])
    return out.withColumn("side", F.when(F.col("price") < F.col("spot"), "support").otherwise("resistance"))

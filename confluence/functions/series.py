"""Columns over ordered series: every one a window over (symbol, date), so a plan that uses many of
them has one exchange and one sort.

Recursive smoothing has a closed form, y_t = q^t * sum(c_i x_i q^-i).  As q^-i would overflow beyond some
3,100 bars, sums run within blocks of BLOCK bars, and the block before is added with its decay; the weight of
what lies further back is below 1e-12.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confluence import config as C

#: Bars of one block of a recursive sum.
BLOCK = 2800


def by(symbol: str = "symbol", date: str = "date"):
    """The window of a series."""
    return W.partitionBy(symbol).orderBy(date)


def numbered(bars: DataFrame, today: str | None = None, symbol: str = "symbol", date: str = "date") -> DataFrame:
    """Bars without those that lack a close, and ``rn`` from 0; as of ``today``, only those up to it."""
    own = as_of(bars, today, date).filter(F.col("close").isNotNull() & ~F.isnan("close"))
    return own.withColumn("rn", F.row_number().over(by(symbol, date)) - 1)


def as_of(rows: DataFrame, today: str | None, date: str = "date") -> DataFrame:
    """What was known at the end of a day: all that follows from these rows, the last bar included, is as of that day."""
    return rows if today is None else rows.filter(F.col(date) <= F.lit(today).cast("date"))


def sma(x: Column, n: int, w=None) -> Column:
    """Mean of the last n rows, null before there are n."""
    f = (w or by()).rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(f) == n, F.avg(x).over(f))


def ewm(x: Column, alpha: float, rn: Column | None = None) -> Column:
    """Exponential smoothing seeded by row 0 of the series (``rn`` numbers rows from 0)."""
    rn = F.col("rn") if rn is None else rn
    q = F.lit(1.0 - alpha)
    weight = F.when(rn == 0, 1.0).otherwise(alpha)
    block, at = F.floor(rn / BLOCK), rn % BLOCK
    own = F.sum(weight * x * F.pow(q, -at)).over(W.partitionBy("symbol", block).orderBy("date").rowsBetween(W.unboundedPreceding, 0))
    before = F.sum(weight * x * F.pow(q, BLOCK - 1 - at)).over(W.partitionBy("symbol").orderBy(block).rangeBetween(-1, -1))
    return own * F.pow(q, at) + F.coalesce(before, F.lit(0.0)) * F.pow(q, at + 1)


def ema(x: Column, n: int) -> Column:
    """Exponential average of span n, null for series of fewer than n rows."""
    whole = W.partitionBy("symbol")
    return F.when(F.count(x).over(whole) >= n, ewm(x, 2.0 / (n + 1)))


def with_rsi(df: DataFrame, close: str = "close", n: int = C.RSI_LENGTH, name: str = "rsi") -> DataFrame:
    """Adds Wilder's RSI: both averages start at 0 in row 0; 100 without losses, 50 without any move."""
    step = F.coalesce(F.col(close) - F.lag(close).over(by()), F.lit(0.0))
    df = df.withColumns({"_up": F.greatest(step, F.lit(0.0)), "_down": F.greatest(-step, F.lit(0.0))})
    df = df.withColumns({"_up": ewm(F.col("_up"), 1.0 / n), "_down": ewm(F.col("_down"), 1.0 / n)})
    flat = F.when(F.col("_up") > 0, 100.0).otherwise(50.0)
    rsi = F.when(F.col("_down") == 0, flat).otherwise(100.0 - 100.0 / (1.0 + F.col("_up") / F.nullif(F.col("_down"), F.lit(0.0))))
    return df.withColumn(name, rsi).drop("_up", "_down")


def with_macd(df: DataFrame, close: str = "close", name: str = "macd_hist") -> DataFrame:
    """Adds the MACD histogram and its state against some bars ago."""
    line = ewm(F.col(close), 2.0 / (C.MACD_FAST + 1)) - ewm(F.col(close), 2.0 / (C.MACD_SLOW + 1))
    df = df.withColumn("_line", line)
    df = df.withColumn(name, F.col("_line") - ewm(F.col("_line"), 2.0 / (C.MACD_SIGNAL + 1))).drop("_line")
    before = F.lag(name, C.MACD_LOOKBACK).over(by())
    now = F.col(name)
    still = F.abs(before) < C.EPSILON  # then the sign of today's value says the way
    flat = F.when(still, F.abs(now) < C.EPSILON).otherwise(F.abs(now - before) < C.MACD_NEUTRAL * F.abs(before))
    rises = F.when(still, now > 0).otherwise(now > before)
    sign = F.when(now >= 0, "positivo").otherwise("negativo")
    way = F.concat(F.when(rises, "subiendo_").otherwise("bajando_"), sign)
    return df.withColumn("macd_state", F.when(before.isNull() | flat, "neutral").otherwise(way))


def with_atr(df: DataFrame, n: int = C.ATR_LENGTH, name: str = "atr") -> DataFrame:
    """Adds Wilder's average true range; row 0 has high - low."""
    last = F.lag("close").over(by())
    df = df.withColumn("_range", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last)))
    return df.withColumn(name, ewm(F.col("_range"), 1.0 / n)).drop("_range")


def with_hv(df: DataFrame, name: str = "hv") -> DataFrame:
    """Adds annualised volatility of 20 log returns."""
    df = df.withColumn("_log", F.log(F.col("close") / F.lag("close").over(by())))
    f = by().rowsBetween(-(C.HV_LENGTH - 1), 0)
    return df.withColumn(name, F.when(F.count("_log").over(f) == C.HV_LENGTH, F.stddev_samp("_log").over(f) * F.sqrt(F.lit(C.DAYS_PER_YEAR)))).drop("_log")


def wma(x: Column, n: int, w=None) -> Column:
    """Linearly weighted mean of the last n rows: two running sums."""
    f = (w or by()).rowsBetween(-(n - 1), 0)
    rn = F.col("rn")
    total = F.sum(x * rn).over(f) - (rn - n) * F.sum(x).over(f)
    return F.when(F.count(x).over(f) == n, total / (n * (n + 1) / 2.0))


def with_hma(df: DataFrame, close: str = "close", n: int = C.HMA_WEEKS, name: str = "hma") -> DataFrame:
    """Adds Hull's average, wma(2 wma(n / 2) - wma(n), sqrt n)."""
    half, root = max(2, n // 2), max(2, round(n**0.5))
    df = df.withColumn("_raw", 2 * wma(F.col(close), half) - wma(F.col(close), n))
    return df.withColumn(name, wma(F.col("_raw"), root)).drop("_raw")


def weekly(bars: DataFrame) -> DataFrame:
    """Bars by weeks that end on Fridays, the running week with them."""
    end = F.next_day(F.date_sub("date", 1), "FRI")
    return bars.groupBy("symbol", end.alias("date")).agg(
        F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"),
    )


def last_rows(df: DataFrame) -> DataFrame:
    """The newest row of each symbol: an aggregate that sums up before any shuffle."""
    return df.groupBy("symbol").agg(F.max_by(F.struct(*df.columns), "date").alias("_last")).select("_last.*")

"""Chart patterns: double bottoms, capitulation with reclaim, weekly slope flips.  Days are bars here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confluence import config as C
from confluence.functions import series as S


def double_bottom(bars: DataFrame, found: DataFrame) -> DataFrame:
    """symbol, l1_rn, l2_rn, l1, l2, neckline, bounce, confirmed: the newest pair of alike pivot lows with a bounce between.

    The neckline is the highest pivot high strictly between the lows, or else the highest high from one to the other.
    Both are maxima of a range of bars: each low keeps the maxima of 1, 2, 4, ... bars that begin and that end there, and
    a pair takes the larger of two that cover its range.  Lows meet within stretches as long as the widest pair.
    """
    least, most = C.DOUBLE_BOTTOM_GAP
    pivot = lambda kind, name: F.max(F.when(F.col("kind") == kind, F.col("price"))).alias(name)
    recent = found.filter(F.col("rn") >= F.col("top") - C.DOUBLE_BOTTOM_BARS).groupBy("symbol", "rn").agg(pivot("low", "low_price"), pivot("high", "peak"), F.first("spot").alias("spot"))
    own = bars.filter(F.col("rn") >= F.col("top") - C.DOUBLE_BOTTOM_BARS).select("symbol", "rn", "high").join(recent, ["symbol", "rn"], "left")
    w = W.partitionBy("symbol").orderBy("rn")
    steps = range((most + 1).bit_length())
    own = own.withColumns({"high_0": F.col("high"), "peak_0": F.col("peak")})
    for k in steps[1:]:  # the maximum of 2^k bars from a bar on
        own = own.withColumns({f"{x}_{k}": F.greatest(f"{x}_{k - 1}", F.lead(f"{x}_{k - 1}", 1 << (k - 1)).over(w)) for x in ("high", "peak")})
    own = own.select(
        "symbol", "rn", "low_price", "spot",
        F.array(*[f"high_{k}" for k in steps]).alias("high_from"), F.array(*[F.lag(f"high_{k}", (1 << k) - 1).over(w) for k in steps]).alias("high_to"),
        F.array(*[F.lead(f"peak_{k}", 1).over(w) for k in steps]).alias("peak_from"), F.array(*[F.lag(f"peak_{k}", 1 << k).over(w) for k in steps]).alias("peak_to"),
    ).filter("low_price is not null")
    stretch = F.floor(F.col("rn") / most)
    a = own.select("symbol", F.col("rn").alias("l1_rn"), F.col("low_price").alias("l1"), "high_from", "peak_from", F.explode(F.array(stretch, stretch + 1)).alias("stretch"))
    b = own.select("symbol", F.col("rn").alias("l2_rn"), F.col("low_price").alias("l2"), "spot", "high_to", "peak_to", stretch.alias("stretch"))
    pairs = a.join(b, ["symbol", "stretch"]).filter((F.col("l2_rn") - F.col("l1_rn")).between(least, most) & (F.abs(F.col("l2") - F.col("l1")) / F.col("l1") < C.DOUBLE_BOTTOM_TOLERANCE))
    widest = lambda n: F.length(F.bin(n)) - 1  # the largest power of two up to n
    over = lambda x, n: F.greatest(F.get(f"{x}_from", widest(n)), F.get(f"{x}_to", widest(n)))
    gap = F.col("l2_rn") - F.col("l1_rn")
    whole = pairs.withColumn("neckline", F.coalesce(over("peak", gap - 1), over("high", gap + 1)))
    lower = F.least("l1", "l2")
    whole = whole.withColumn("bounce", (F.col("neckline") - lower) / lower).filter(F.col("bounce") >= C.DOUBLE_BOTTOM_BOUNCE)
    order = W.partitionBy("symbol").orderBy(F.desc("l2_rn"), "l1_rn")
    one = whole.withColumn("_pick", F.row_number().over(order)).filter("_pick = 1")
    return one.select("symbol", "l1_rn", "l2_rn", "l1", "l2", "neckline", "bounce", (F.col("spot") > F.col("neckline")).alias("confirmed"))


def capitulation(bars: DataFrame, range_atr: float = C.CAPITULATION_RANGE, volume: float = C.CAPITULATION_VOLUME, close: float = C.CAPITULATION_CLOSE, drop: float = C.CAPITULATION_DROP) -> DataFrame:
    """symbol, climax_rn, climax_close, reclaim_rn: a wide, heavy bar after a drop, then a close above its close within
    ten bars with no low at or below its low up to then.  The last ten bars can't be a climax."""
    w = S.by()
    calm = F.avg("volume").over(w.rowsBetween(-20, -1))
    before = F.lag("close", 1).over(w) / F.lag("close", C.CAPITULATION_DROP_BARS + 1).over(w) - 1
    span = F.col("high") - F.col("low")
    df = bars.withColumns({"_calm": calm, "_before": before, "_span": span})
    climax = df.filter(
        F.col("rn").between(F.col("top") - C.CAPITULATION_BARS, F.col("top") - C.RECLAIM_BARS) & (F.col("rn") >= 20) & (F.col("_span") > range_atr * F.col("atr"))
        & (F.col("volume") > volume * F.col("_calm")) & (F.try_divide(F.col("close") - F.col("low"), F.col("_span")) > close) & (F.col("_before") < drop)
    ).select("symbol", F.col("rn").alias("climax_rn"), F.col("close").alias("climax_close"), F.col("low").alias("climax_low"))
    after = climax.join(bars.select("symbol", "rn", "close", "low"), "symbol").filter((F.col("rn") > F.col("climax_rn")) & (F.col("rn") <= F.col("climax_rn") + C.RECLAIM_BARS))
    running = F.min("low").over(W.partitionBy("symbol", "climax_rn").orderBy("rn").rowsBetween(W.unboundedPreceding, 0))
    back = after.withColumn("lowest", running).filter((F.col("lowest") > F.col("climax_low")) & (F.col("close") > F.col("climax_close")))
    first = back.groupBy("symbol", "climax_rn", "climax_close").agg(F.min("rn").alias("reclaim_rn"))
    order = W.partitionBy("symbol").orderBy(F.desc("reclaim_rn"), F.desc("climax_rn"))
    return first.withColumn("_pick", F.row_number().over(order)).filter("_pick = 1").drop("_pick")


def hma_flip(weeks: DataFrame) -> DataFrame:
    """symbol, weeks_since, close_above, valid: the last turn of the weekly Hull average's slope from falling to rising.

    Symbols with fewer than 100 weeks, or without a turn, are left out.
    """
    df = S.with_hma(weeks).withColumn("n", F.count("*").over(W.partitionBy("symbol"))).filter(F.col("n") >= C.HMA_MIN_WEEKS)
    last = F.lag("hma").over(S.by())
    df = df.withColumn("slope", (F.col("hma") - last) / last)
    df = df.withColumn("turn", (F.lag("slope").over(S.by()) < 0) & (F.col("slope") > C.HMA_SLOPE))
    out = df.groupBy("symbol").agg(F.max(F.when(F.col("turn"), F.col("rn"))).alias("turn_rn"), F.max("rn").alias("top"), F.max_by("close", "rn").alias("close"), F.max_by("hma", "rn").alias("hma"))
    since = F.col("top") - F.col("turn_rn")
    return out.filter("turn_rn is not null").select("symbol", since.alias("weeks_since"), (F.col("close") > F.col("hma")).alias("close_above"), (since < C.HMA_RECENT).alias("valid"))

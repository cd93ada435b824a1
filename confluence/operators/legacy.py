"""The first generation of types: T1 uptrend, T2 panic, T3 range, T4 dip after earnings; T1 > T2 > T4 > T3."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluence import config as C
from confluence.functions import series as S


def types(bars: DataFrame, weeks: DataFrame, earnings: DataFrame) -> DataFrame:
    """symbol, t1 .. t4, kind (null: none), others (matching types that lost), for symbols with both weekly averages.

    ``bars`` has rn, rsi, top and spot.
    """
    week = S.last_rows(weeks.withColumns({"a": S.sma(F.col("close"), 50), "b": S.sma(F.col("close"), 200)})).select("symbol", "a", "b").filter("b > 0 and a is not null")
    peak = F.max("close").over(S.by().rowsBetween(-5, -1))
    last = S.last_rows(bars.withColumn("peak", peak)).select("symbol", "spot", "peak", "top", "rsi", F.col("date").alias("today"))
    span = bars.filter(F.col("rn") > F.col("top") - C.T3_BARS).groupBy("symbol").agg(F.min("close").alias("low"), F.max("close").alias("high"), F.avg("close").alias("mean"), F.count("*").alias("n"))
    event = earnings.join(last.select("symbol", "today"), "symbol").filter((F.col("date") <= F.col("today")) & (F.col("date") >= F.date_sub("today", C.T4_DAYS))).groupBy("symbol").agg(F.max("date").alias("event"))
    near = bars.select("symbol", "date", "close").join(event, "symbol").groupBy("symbol").agg(
        F.max_by(F.when(F.col("date") < F.col("event"), F.col("close")), F.when(F.col("date") < F.col("event"), F.col("date"))).alias("before"),
        F.min_by(F.when(F.col("date") > F.col("event"), F.col("close")), F.when(F.col("date") > F.col("event"), F.col("date"))).alias("after"),
    )
    df = week.join(last, "symbol").join(span, "symbol").join(near, "symbol", "left")
    apart = F.abs(F.col("a") - F.col("b")) / F.col("b")
    t1 = (F.col("a") > F.col("b")) & (F.col("spot") > F.col("b"))
    t2 = (F.col("top") >= C.T2_MIN_BARS - 1) & (F.col("spot") / F.col("peak") - 1 <= C.T2_DROP) & ((F.col("a") > F.col("b")) | (apart <= C.T3_TOLERANCE))
    spread = F.col("high") - F.col("low")
    t3 = (apart <= C.T3_TOLERANCE) & (F.col("n") >= C.T3_BARS) & (spread / F.col("mean") <= C.T3_COMPACT) & (F.col("spot") < F.col("low") + C.T3_FLOOR * spread)
    t4 = (F.col("after") / F.col("before") - 1 <= C.T4_DROP) & (F.col("a") >= F.col("b") * C.T4_TREND) & (F.col("rsi") < C.T4_RSI)
    no = F.lit(False)
    df = df.select("symbol", *[F.coalesce(t, no).alias(n) for n, t in (("t1", t1), ("t2", t2), ("t3", t3), ("t4", t4))])
    kind = F.coalesce(*[F.when(F.col(n), n.upper()) for n in ("t1", "t2", "t4", "t3")])
    found = F.array_compact(F.array(*[F.when(F.col(n), n.upper()) for n in ("t1", "t2", "t3", "t4")]))
    df = df.withColumns({"kind": kind, "found": found})
    return df.select("symbol", "t1", "t2", "t3", "t4", "kind", F.array_join(F.array_remove("found", F.coalesce("kind", F.lit(""))), ",").alias("others"))

"""Pivots: local extremes of enough depth, in the order in which they are accepted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confluence import config as C
from confluence.functions import series as S


#: Facts of a bar and of its series (``levels.context``) that pivots keep, so that no level has to look them up.
CARRIED = ("rsi", "macd_hist", "top", "spot", "last_atr")


def candidates(bars: DataFrame) -> DataFrame:
    """symbol, date, rn, kind, price, atr, back, CARRIED: strict and unique extremes of 5 bars on each side.

    ``bars`` has rn, high, low and atr, and of CARRIED what it has; the rest is null.  A bar that is both counts as a low.  ``back`` is the extreme of the 20 bars
    before on the other side, against which depth counts while there is no opposite pivot.
    """
    n = C.PIVOT_REACH
    w = S.by()
    around, before, behind = w.rowsBetween(-n, n), w.rowsBetween(-n, -1), w.rowsBetween(1, n)
    past = w.rowsBetween(-C.PIVOT_FALLBACK, -1)
    whole = F.count("*").over(around) == 2 * n + 1
    is_low = whole & (F.col("low") < F.min("low").over(before)) & (F.col("low") < F.min("low").over(behind))
    is_high = whole & (F.col("high") > F.max("high").over(before)) & (F.col("high") > F.max("high").over(behind))
    kind = F.when(is_low, "low").when(is_high, "high")
    out = bars.withColumns({"kind": kind, "_above": F.max("high").over(past), "_below": F.min("low").over(past)}).filter("kind is not null")
    low = F.col("kind") == "low"
    return out.select("symbol", "date", "rn", "kind", F.when(low, F.col("low")).otherwise(F.col("high")).alias("price"), "atr", F.when(low, F.col("_above")).otherwise(F.col("_below")).alias("back"), *[(F.col(c) if c in bars.columns else F.lit(None)).cast("double").alias(c) for c in CARRIED])


def accepted(found: DataFrame) -> DataFrame:
    """symbol, date, rn, kind, price, atr, CARRIED: candidates whose depth is at least the bar's ATR.

    Depth is measured against the last accepted opposite pivot, so the candidates of a symbol are folded in order;
    a symbol has few of them (one in eleven bars at most).
    """
    item = F.struct("rn", "date", "kind", "price", "atr", "back", *CARRIED)
    listed = found.groupBy("symbol").agg(F.array_sort(F.collect_list(item)).alias("items"))
    start = F.expr(
        "struct(cast(null as double) as low, cast(null as double) as high,"
        f" cast(array() as array<struct<rn: int, date: date, kind: string, price: double, atr: double, {', '.join(f'{c}: double' for c in CARRIED)}>>) as taken)"
    )

    def step(s, x):
        low = x["kind"] == "low"
        other = F.coalesce(F.when(low, s["high"]).otherwise(s["low"]), x["back"])
        depth = F.when(low, other - x["price"]).otherwise(x["price"] - other)
        ok = F.coalesce((x["atr"] > 0) & (depth >= C.PIVOT_DEPTH * x["atr"]), F.lit(False))
        kept = F.array_append(s["taken"], F.struct(x["rn"].cast("int").alias("rn"), x["date"].alias("date"), x["kind"].alias("kind"), x["price"].alias("price"), x["atr"].alias("atr"), *[x[c].alias(c) for c in CARRIED]))
        return F.struct(
            F.when(ok & low, x["price"]).otherwise(s["low"]).alias("low"),
            F.when(ok & ~low, x["price"]).otherwise(s["high"]).alias("high"),
            F.when(ok, kept).otherwise(s["taken"]).alias("taken"),
        )

    folded = listed.select("symbol", F.aggregate("items", start, step, lambda s: s["taken"]).alias("taken"))
    return folded.select("symbol", F.inline("taken"))


def pivots(bars: DataFrame) -> DataFrame:
    return accepted(candidates(bars))


def latest(found: DataFrame, n: int) -> DataFrame:
    """The last n pivots of each symbol with ``back`` 1 .. n."""
    order = W.partitionBy("symbol").orderBy(F.col("rn").desc())
    return found.withColumn("back", F.row_number().over(order)).filter(F.col("back") <= n)

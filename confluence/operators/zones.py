"""Zones: support levels clustered in one dimension, scored, gated and ranked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confluence import config as C
from confluence.functions.text import fixed


def weight(element: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in C.WEIGHTS.items() for x in pair])
    return F.coalesce(F.element_at(table, element), F.lit(0.0))


def category(element: Column) -> Column:
    out = F.when(element.startswith("fib"), "fibonacci").when(element.startswith("avwap"), "avwap")
    return out.when(element.isin("sma_200d", "sma_200w", "ema_200d"), "sma_200").when(element.isin("sma_50d", "sma_50w", "ema_50d"), "sma_50").otherwise(element)


def clustered(levels: DataFrame) -> DataFrame:
    """``levels`` below spot with ``cluster``: a new one begins where the gap to the price below is over the tolerance."""
    own = levels.filter("side = 'support'").drop("side")
    order = W.partitionBy("symbol").orderBy("price", "element", "rn")
    tolerance = F.least(C.CLUSTER_ATR * F.col("last_atr"), C.CLUSTER_SPOT * F.col("spot"))
    starts = F.coalesce((F.col("price") - F.lag("price").over(order) > tolerance).cast("int"), F.lit(0))
    return own.withColumn("_starts", starts).withColumn("cluster", F.sum("_starts").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("_starts")


def density(n_heavy: Column, width: Column) -> Column:
    raw = 1 + (n_heavy / F.greatest(width, F.lit(C.DENSITY_FLOOR)) - C.DENSITY_REFERENCE) * C.DENSITY_SLOPE
    return F.when(n_heavy <= 0, 1.0).otherwise(F.greatest(F.lit(C.DENSITY_LOW), F.least(F.lit(C.DENSITY_HIGH), raw)))


def tier(score: Column) -> Column:
    return reduce(lambda out, t: out.when(score >= t[0], t[1]), C.TIERS[1:], F.when(score >= C.TIERS[0][0], C.TIERS[0][1])).otherwise(1)


def zones(members: DataFrame) -> DataFrame:
    """One row per cluster that isn't too wide: bounds, score, counts, reasons, and rank within the symbol.

    A category counts once, with its heaviest element; many heavy elements in a narrow zone raise the score.
    ``signals``: the oscillators of its divergences.
    """
    w, c = weight(F.col("element")), category(F.col("element"))
    dynamic = reduce(Column.__or__, [F.col("element").startswith(x) for x in C.CONFIRMERS])
    by_category = members.groupBy("symbol", "spot", "last_atr", "cluster", c.alias("category")).agg(
        F.max(w).alias("best"), F.min("price").alias("low"), F.max("price").alias("high"), F.count_if(w >= C.HEAVY_WEIGHT).alias("heavy"),
        F.bool_or(dynamic).alias("dynamic"), F.count("*").alias("n"), F.collect_list(F.struct("price", "element", "detail")).alias("held"),
    )
    z = by_category.groupBy("symbol", "spot", "last_atr", "cluster").agg(
        F.sum("best").alias("raw"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("heavy").alias("n_heavy"), F.bool_or("dynamic").alias("dynamic"),
        F.count("*").alias("n_categories"), F.sum("n").alias("n_elements"), F.array_sort(F.flatten(F.collect_list("held"))).alias("held"),
    )
    center = (F.col("low") + F.col("high")) / 2
    z = z.withColumn("center", center).filter((F.col("high") - F.col("low")) / F.col("center") <= C.CLUSTER_WIDTH)
    buffer = C.CLUSTER_BUFFER * F.col("center")
    z = z.withColumns({"lower": F.col("low") - buffer, "upper": F.col("high") + buffer})
    z = z.withColumns({"width_pct": (F.col("upper") - F.col("lower")) / F.col("center"), "distance": (F.col("spot") - F.col("upper")) / F.col("spot"), "elements": F.transform("held", lambda e: e["element"]), "atr": F.col("last_atr")})
    z = z.withColumn("score", F.col("raw") * density(F.col("n_heavy"), F.col("width_pct")))
    z = z.withColumn("signals", F.transform(F.filter("held", lambda e: e["element"] == "divergence"), lambda e: F.coalesce(e["detail"], F.lit("divergence"))))
    z = z.withColumn("rejection_reason", reasons()).drop("last_atr")
    return ranked(z.withColumns({"tier": tier(F.col("score")), "is_valid": F.col("rejection_reason") == ""}))


def reasons() -> Column:
    """Every gate that a zone fails, joined by `` | ``; empty for valid zones.  The wording is fixed."""
    distance = F.col("distance")
    near = F.concat(F.lit("zona muy cerca del spot ("), fixed(distance * 100, 1), F.lit(f"% < {C.MIN_DISTANCE:.0%}), no accionable para 30-45 DTE"))
    few = F.concat(F.lit("solo "), F.col("n_heavy").cast("string"), F.lit(f" elementos peso >= {C.HEAVY_WEIGHT} (requeridos {C.MIN_HEAVY})"))
    return F.concat_ws(
        " | ",
        F.when(F.col("score") < C.MIN_SCORE, f"score < {C.MIN_SCORE}"),
        F.when(~F.col("dynamic"), "sin confirmador dinámico"),
        F.when((distance < 0) | (distance > C.MAX_DISTANCE), "fuera de rango de proximidad (>10% o por encima del spot)"),
        F.when(distance < C.MIN_DISTANCE, near),
        F.when(F.col("n_heavy") < C.MIN_HEAVY, few),
    )


def ranked(z: DataFrame) -> DataFrame:
    """Adds zone_id (valid zones first, best to worst) and is_best."""
    order = W.partitionBy("symbol").orderBy(F.desc("is_valid"), F.round("score", 9).desc(), F.round("distance", 9), F.desc("n_categories"), "cluster")
    return z.withColumn("zone_id", F.row_number().over(order) - 1).withColumn("is_best", F.col("is_valid") & (F.col("zone_id") == 0))


def best(z: DataFrame) -> DataFrame:
    return z.filter("is_best")

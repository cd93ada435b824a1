"""Heuristic strikes on a currency's price grid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from confluence import config as C


def grid(spot: Column, currency: Column) -> Column:
    """The grid of a price: a currency's tier table, or else 1 % of the price to one significant digit, a cent for prices up to 0."""
    raw = spot * 0.01
    magnitude = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    out = F.when(spot <= 0, 0.01).otherwise(F.bround(raw / magnitude, 0) * magnitude)
    for name, tiers in C.GRIDS.items():
        step = F.lit(tiers[-1][1])
        for most, size in reversed(tiers[:-1]):
            step = F.when(spot <= most, size).otherwise(step)
        out = F.when(currency == name, step).otherwise(out)
    return out


def on_grid(price: Column, step: Column) -> Column:
    """The nearest grid price, halves up."""
    return F.floor(price / step + 0.5) * step


def strikes(lower: Column, upper: Column, center: Column, spot: Column, atr: Column, currency: Column) -> dict[str, Column]:
    step = grid(spot, currency)
    return {
        "strike_aggressive": on_grid(F.greatest(upper, spot - C.STRIKE_ATR * atr), step),
        "strike_natural": on_grid(center, step),
        "strike_conservative": on_grid(lower - C.STRIKE_ATR * atr, step),
    }

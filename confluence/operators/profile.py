"""Volume profiles of every day: a year's volume over equal price buckets, and its dense runs, as of each bar in one pass.

Series are cut into blocks of days; a block also gets the bars of the year before its first day, so a long series spreads over
tasks and no bar is sent more often than once for each block that it reaches.  Within a block the window slides:
while its price range stands, a day adds one bar's shares and takes one away; the shares of a stretch of days with one
range are computed at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluence import config as C
from confluence.operators import levels as L

#: Days of one block.
BLOCK = 2048
DAILY = "symbol string, date date, rn int, spot double, bottom double, width double, volumes array<double>, nodes array<struct<first: int, last: int, low: double, high: double>>"


def shares(high, low, close, volume, bottom: float, width: float, buckets: int) -> np.ndarray:
    """How each bar's volume is dealt to the buckets: by the part of its range in each, or to its close's bucket."""
    span = high - low
    left = bottom + np.arange(buckets) * width
    overlap = np.minimum(high[:, None], left + width) - np.maximum(low[:, None], left)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(span[:, None] > 0, np.maximum(overlap, 0.0) / span[:, None] * volume[:, None], 0.0)
    flat = np.flatnonzero(span <= 0)
    out[flat, np.clip(((close[flat] - bottom) / width).astype(int), 0, buckets - 1)] = volume[flat]
    return out


def runs(volumes: np.ndarray, percentile: float) -> list[tuple[int, int]]:
    """(first, last) of the neighbouring buckets at or above the percentile."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], volumes >= np.percentile(volumes, 100 * percentile), [False]]).astype(int)))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


def _extreme(x: np.ndarray, n: int, of) -> np.ndarray:
    """``of`` the n values from each place on."""
    return of(np.lib.stride_tricks.sliding_window_view(x, n), axis=1)


def sliding(bars: DataFrame, window: int = C.LEVEL_WINDOW, buckets: int = C.HVN_BUCKETS, percentile: float = C.HVN_PERCENTILE, block: int = BLOCK) -> DataFrame:
    """The profile as of each bar that ends a whole window and whose window has a range (columns as in DAILY).

    ``bars``: symbol, date, rn from 0 without holes, high, low, close, volume.  Shorter series have no rows.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn", ignore_index=True)
        high, low, close, volume = (pdf[c].to_numpy(float) for c in ("high", "low", "close", "volume"))
        out = []
        if len(pdf) >= window:
            bottom, top = _extreme(low, window, np.min), _extreme(high, window, np.max)
            first = np.flatnonzero(np.concatenate([[True], (np.diff(bottom) != 0) | (np.diff(top) != 0)]))
            for a, b in zip(first, np.append(first[1:], len(bottom))):  # days a .. b - 1 share a range
                width = (top[a] - bottom[a]) / buckets
                if not width > 0:
                    continue
                own = slice(a, b + window - 1)
                dealt = shares(high[own], low[own], close[own], volume[own], bottom[a], width, buckets)
                for day in range(a, b):
                    volumes = dealt[day - a : day - a + window].sum(axis=0)
                    nodes = [(i, j, bottom[a] + i * width, bottom[a] + (j + 1) * width) for i, j in runs(volumes, percentile)]
                    out.append((day + window - 1, bottom[a], width, volumes, nodes))
        at, lists = [o[0] for o in out], lambda values: pd.Series(values, dtype=object)
        columns = {"symbol": key[0], "date": pdf["date"].iloc[at].to_numpy(), "rn": pdf["rn"].iloc[at].to_numpy(), "spot": close[at], "bottom": [o[1] for o in out], "width": [o[2] for o in out]}
        nodes = [[dict(zip(("first", "last", "low", "high"), n)) for n in o[4]] for o in out]
        return pd.DataFrame(columns | {"volumes": lists([o[3] for o in out]), "nodes": lists(nodes)})

    last = F.floor((F.col("rn") + window - 1) / block)
    sent = bars.select("symbol", "date", F.col("rn").cast("int").alias("rn"), "high", "low", "close", "volume", F.explode(F.sequence(F.floor(F.col("rn") / block), last)).alias("block"))
    # a block has the year before its first day, so its whole windows are those that end on its own days
    return sent.groupBy("symbol", "block").applyInPandas(run, DAILY)


def node_levels(daily: DataFrame) -> DataFrame:
    """The dense runs as levels of their day (columns as in ``levels.COLUMNS``, and date)."""
    each = daily.select("symbol", "date", "spot", F.inline("nodes"))
    return each.select("symbol", F.lit("hvn").alias("element"), ((F.col("low") + F.col("high")) / 2).alias("price"), F.col("first").cast("long").alias("rn"), F.concat_ws("-", F.col("first").cast("string"), F.col("last").cast("string")).alias("detail"), "spot", F.lit(None).cast("double").alias("last_atr"), "date").select(*L.COLUMNS, "date")

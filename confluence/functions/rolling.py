"""Order statistics of a sliding window, for every bar.

A sorted list holds the window: a bar adds one value and takes one away, and a rank or a percentile is read off it.  Series
are cut into blocks of bars; a block also gets the ``n - 1`` bars before it, so a long series spreads over tasks.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bars of one block.
BLOCK = 4096
SCHEMA = "symbol string, date date, rn int, n long, share double, percentile double"


def _slid(values: list[float], n: int, quantile: float, skip: int):
    """(count, share up to the value itself, percentile) of the last n values, from the ``skip``-th on; nulls aren't counted."""
    held: list[float] = []
    for i, x in enumerate(values):
        if i >= n and (old := values[i - n]) == old:
            del held[bisect_left(held, old)]
        if x == x:
            insort(held, x)
        if i < skip:
            continue
        size = len(held)
        share = bisect_right(held, x) / size if x == x else None
        if size:
            at = quantile * (size - 1)
            low = int(at)
            between = held[low] + (at - low) * (held[min(low + 1, size - 1)] - held[low])
        yield size, share, between if size else None


def order_statistics(bars: DataFrame, value: str, n: int, quantile: float = 0.8) -> DataFrame:
    """symbol, date, rn, n, share, percentile for every bar: how many of the last n bars have a value, the share of those
    up to the bar's own (ties count; null for a null or NaN value), and the percentile of them with linear interpolation.

    ``bars`` has symbol, date and rn from 0 without gaps.  Equal to a window of the last n rows, in n log n steps a block.
    """
    block, at = F.floor(F.col("rn") / BLOCK).cast("int"), F.col("rn") % BLOCK
    to = F.array_compact(F.array(block, *[F.when(at >= BLOCK * k - n + 1, block + k) for k in range(1, -(-n // BLOCK) + 1)]))
    sent = bars.select("symbol", "date", F.col("rn").cast("int").alias("rn"), F.col(value).cast("double").alias("value"), F.explode(to).alias("block"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rn", kind="stable")
        skip = int((rows["rn"] < rows["block"].iat[0] * BLOCK).sum())
        found = pd.DataFrame(_slid(rows["value"].tolist(), n, quantile, skip), columns=["n", "share", "percentile"])
        kept = rows[["symbol", "date", "rn"]].iloc[skip:].reset_index(drop=True)
        return pd.concat([kept, found], axis=1)

    return sent.groupBy("symbol", "block").applyInPandas(run, SCHEMA)

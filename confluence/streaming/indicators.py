"""Indicators that go on from kept state as bars arrive, corrected ones among them.

A symbol's state is its newest KEEP bars, each with the smoothed values after it.  A batch rolls back to the last bar before
its first one and goes over the bars from there, stored ones and new ones, so a correction within the kept bars
gives what the whole corrected series would give, and a batch that comes twice changes nothing.  Corrections of older
bars can't be worked in; they come out as rows with ``late`` true and change nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from confluence import config as C
from confluence.streaming.bars import SCHEMA

#: Bars whose correction is worked in; sources send the last ``REFRESH_BARS`` again.
KEEP = 4 * C.REFRESH_BARS
SMOOTHED = ("fast", "slow", "signal", "up", "down", "atr", "ema_50", "ema_200")
STATE = "date int, high double, low double, close double, n long, " + ", ".join(f"{c} double" for c in SMOOTHED)
OUT = "symbol string, date date, close double, n long, ema_50 double, ema_200 double, rsi double, macd_hist double, atr double, late boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = pd.Timestamp("1970-01-01")


def _smooth(last: float | None, x: float, alpha: float) -> float:
    return x if last is None else (1.0 - alpha) * last + alpha * x


def after(last: dict | None, date: int, high: float, low: float, close: float) -> dict:
    """The state after one bar more."""
    was = last or dict.fromkeys(SMOOTHED)
    move = close - last["close"] if last else 0.0
    true_range = max(high - low, abs(high - last["close"]), abs(low - last["close"])) if last else high - low
    fast, slow = (_smooth(was[c], close, 2.0 / (n + 1)) for c, n in (("fast", C.MACD_FAST), ("slow", C.MACD_SLOW)))
    return {
        "date": date, "high": high, "low": low, "close": close, "n": last["n"] + 1 if last else 1,
        "fast": fast, "slow": slow, "signal": _smooth(was["signal"], fast - slow, 2.0 / (C.MACD_SIGNAL + 1)),
        "up": _smooth(was["up"], max(move, 0.0), 1.0 / C.RSI_LENGTH), "down": _smooth(was["down"], max(-move, 0.0), 1.0 / C.RSI_LENGTH),
        "atr": _smooth(was["atr"], true_range, 1.0 / C.ATR_LENGTH), "ema_50": _smooth(was["ema_50"], close, 2.0 / 51), "ema_200": _smooth(was["ema_200"], close, 2.0 / 201),
    }


def shown(symbol: str, s: dict) -> tuple:
    """A row of OUT; averages need as many bars as their length."""
    rsi = 100.0 - 100.0 / (1.0 + s["up"] / s["down"]) if s["down"] else 100.0 if s["up"] > 0 else 50.0
    return symbol, s["date"], s["close"], s["n"], s["ema_50"] if s["n"] >= 50 else None, s["ema_200"] if s["n"] >= 200 else None, rsi, s["fast"] - s["slow"] - s["signal"], s["atr"], False


def advanced(kept: list[dict], fresh: dict[int, tuple[float, float, float]], keep: int) -> tuple[list[dict], list[dict], list[int]]:
    """(kept, changed, late): the state after ``fresh`` bars (day -> high, low, close), its rows that are new or recomputed, and
    days that lie before all that is kept."""
    whole = not kept or kept[0]["n"] == 1  # nothing has been forgotten yet
    late = [] if whole else sorted(d for d in fresh if d <= kept[0]["date"])
    fresh = {d: b for d, b in fresh.items() if d not in late}
    if not fresh:
        return kept, [], late
    first = min(fresh)
    stays = [s for s in kept if s["date"] < first]
    bars = {s["date"]: (s["high"], s["low"], s["close"]) for s in kept if s["date"] >= first} | fresh
    last, changed = stays[-1] if stays else None, []
    for day in sorted(bars):
        last = after(last, day, *bars[day])
        changed.append(last)
    return (stays + changed)[-keep - 1 :], changed, late


class Indicators(StatefulProcessor):
    def __init__(self, keep: int = KEEP):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.names = [c.split()[0] for c in STATE.split(", ")]
        self.state = handle.getListState("bars", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        batch = batch[batch["close"].notna() & batch["date"].notna()].sort_values(["date", "high", "low", "close"])
        # of several bars of one day the largest wins, in whatever order they come
        days = ((pd.to_datetime(batch["date"]) - _EPOCH).dt.days).tolist()
        fresh = {d: (float(h), float(lo), float(c)) for d, h, lo, c in zip(days, batch["high"], batch["low"], batch["close"])}
        kept = [dict(zip(self.names, row)) for row in self.state.get()] if self.state.exists() else []
        kept, changed, late = advanced(kept, fresh, self.keep)
        if changed:
            self.state.put([tuple(s[n] for n in self.names) for s in kept])
        out = [shown(key[0], s) for s in changed] + [(key[0], d, fresh[d][2], None, None, None, None, None, None, True) for d in late]
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
        frame["date"] = (_EPOCH + pd.to_timedelta(frame["date"], unit="D")).dt.date if out else frame["date"]
        yield frame

    def close(self) -> None:
        pass


def stream(bars: DataFrame, keep: int = KEEP) -> DataFrame:
    """Indicators (columns as in OUT) of a stream of bars: a row for each bar that is new or that a correction has changed.

    Bars without a close are ignored.  State is by symbol.
    """
    bars.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = bars.select("symbol", "date", "high", "low", "close")
    return rows.groupBy("symbol").transformWithStateInPandas(Indicators(keep), OUT, "Update", "None")


def refresh(spark: SparkSession, source: str, store, checkpoint: str, keep: int = KEEP) -> StreamingQuery:
    """Takes the bars of all new files in ``source``, and puts changed indicators into a store partitioned by month; then stops.

    A batch that is repeated after a failure replaces its own rows by the same ones.
    """
    found = stream(spark.readStream.schema(SCHEMA).parquet(source), keep)

    def put(batch: DataFrame, _: int) -> None:
        fresh = batch.filter("not late").drop("late").withColumn("month", F.date_format("date", "yyyy-MM")).persist()
        if not fresh.isEmpty():
            store.upsert(fresh, ["month", "symbol", "date"])
        fresh.unpersist()

    return found.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

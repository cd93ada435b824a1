"""The store of runs, and the stream that writes indicators to one."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from confluence.functions import series as S
from confluence.sources.store import Conflict, Store
from confluence.streaming import indicators as I

KEYS = ["run_id", "symbol"]


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_separate_writes_build_one_row(spark, tmp_path):
    store = Store(spark, str(tmp_path / "candidates"))
    with pytest.raises(LookupError):
        store.load()
    make = lambda data, names: spark.createDataFrame(data, names)
    assert store.write(make([("r1", "A", 1.5), ("r1", "B", 2.5), ("r/2", "A", 9.0)], "run_id string, symbol string, spot double")) == 1
    labels = make([("r1", "A", "uptrend", ["x"]), ("r1", "Z", "lateral", ["y"])], "run_id string, symbol string, regime string, triggers array<string>")
    events = make([("r1", "A", True), ("r1", "B", False), ("r/2", "A", None)], "run_id string, symbol string, flagged boolean")
    for _ in range(2):  # a rerun changes nothing
        store.update(labels, KEYS)
        store.update(events, KEYS)
        assert rows(store.load(), *KEYS, "spot", "regime", "flagged") == [("r/2", "A", 9.0, None, None), ("r1", "A", 1.5, "uptrend", True), ("r1", "B", 2.5, None, False)]
    assert store.versions() == [1, 2, 3, 4, 5] and rows(store.load(version=1), *KEYS, "spot") == [("r/2", "A", 9.0), ("r1", "A", 1.5), ("r1", "B", 2.5)]
    store.upsert(make([("r1", "B", 3.0), ("r1", "C", 4.0), ("r3", "A", 5.0), (None, "A", 6.0)], "run_id string, symbol string, spot double"), KEYS)
    assert rows(store.load(), *KEYS, "spot", "regime") == [("r/2", "A", 9.0, None), ("r1", "A", 1.5, "uptrend"), ("r1", "B", 3.0, None), ("r1", "C", 4.0, None), ("r3", "A", 5.0, None), (None, "A", 6.0, None)]
    one = store.load(["r/2", "none"])
    assert rows(one, "symbol") == [("A",)] and not any("_part=r1" in f or "_part=null" in f for f in one.inputFiles())
    store.write(make([("r1", "Q", 7.0)], "run_id string, symbol string, spot double"))
    assert rows(store.load(["r1"]), "symbol", "regime") == [("Q", None)]
    assert store.clean(keep=1) > 0 and store.versions() == [7] and len(rows(store.load(), "symbol")) == 4 and store.clean(keep=1) == 0


def test_failed_and_late_writes_leave_the_store_as_it_is(spark, tmp_path):
    store, path = Store(spark, str(tmp_path / "s")), tmp_path / "s"
    df = spark.createDataFrame([("r1", "A", 1)], "run_id string, symbol string, n int")
    store.write(df)
    before = sorted(os.listdir(path))
    with pytest.raises(Exception, match="no way"):
        store.write(df.withColumn("n", F.raise_error(F.lit("no way")).cast("int")))
    with pytest.raises(TypeError):
        store.write(df.withColumn("n", F.lit("text")))
    with pytest.raises(ValueError):
        store.update(df.unionAll(df), KEYS)
    assert rows(store.load(), "n") == [(1,)] and set(before) <= set(os.listdir(path)) and store.versions() == [1]
    old = store.manifest()
    store.write(df.withColumn("n", F.lit(2)))
    with pytest.raises(Conflict):  # another writer that began from the same version
        store._written(old, df.withColumn("n", F.lit(3)))
    assert rows(store.load(), "n") == [(2,)]


def whole(bars):
    """The batch result over a whole series."""
    df = S.with_atr(S.with_macd(S.with_rsi(S.numbered(bars))))
    return df.withColumns({"ema_50": F.when(F.col("rn") >= 49, S.ewm(F.col("close"), 2.0 / 51)), "n": F.col("rn").cast("long") + 1})


def test_streamed_indicators_are_those_of_the_corrected_series(spark, tmp_path):
    rng = random.Random(4)
    day = lambda i: datetime.date(2024, 1, 1) + datetime.timedelta(days=i)

    def bar(symbol, i):
        close = 100 + rng.gauss(0, 5)
        return symbol, day(i), close, close + rng.random(), close - rng.random(), close, 10.0

    batches = [[bar("A", i) for i in range(60)] + [bar("B", i) for i in range(0, 20, 2)]]
    batches += [[bar("A", i) for i in range(55, 66)] + [bar("B", i) for i in (3, 18, 19, 30)]]  # corrections, days between
    batches += [batches[1], [bar("A", 66), ("A", day(67), None, None, None, None, None), bar("C", 5)], [bar("A", 2), bar("A", 67)]]  # a batch again, no close, too late
    source, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "out"), "month")
    final, late = {}, ("A", day(2))
    for rows_of in batches:
        final |= {r[:2]: r for r in rows_of if r[5] is not None and r[:2] != late or r[:2] == late and rows_of is batches[0]}
        spark.createDataFrame(rows_of, I.SCHEMA).coalesce(1).write.mode("append").parquet(source)
        query = I.refresh(spark, source, store, str(tmp_path / "state"), keep=20)
        query.awaitTermination(180)
        assert query.exception() is None
    names = ("n", "close", "rsi", "macd_hist", "atr", "ema_50")
    row = lambda r: [float("nan") if r[c] is None else r[c] for c in names]
    want = {(r.symbol, r.date): row(r) for r in whole(spark.createDataFrame(list(final.values()), I.SCHEMA)).collect()}
    got = {(r.symbol, r.date): row(r) for r in store.load().collect()}
    assert set(got) == set(want)
    for key, values in want.items():
        assert got[key] == pytest.approx(values, rel=1e-9, abs=1e-9, nan_ok=True), key


def test_what_is_kept_and_what_is_late():
    fresh = {d: (d + 1.0, d - 1.0, float(d)) for d in range(10)}
    kept, changed, late = I.advanced([], fresh, 3)
    assert [s["date"] for s in kept] == [6, 7, 8, 9] and len(changed) == 10 and not late
    again, changed, late = I.advanced(kept, {7: (9.0, 6.0, 8.0), 6: (9.0, 6.0, 8.0), 1: (9.0, 6.0, 8.0)}, 3)
    assert late == [1, 6] and [s["date"] for s in changed] == [7, 8, 9]
    want = I.advanced([], fresh | {7: (9.0, 6.0, 8.0)}, 3)[0]
    assert again[1:] == want[1:] and I.advanced(again, {}, 3) == (again, [], [])

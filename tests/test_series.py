import datetime

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from confluence import config as C
from confluence.functions import series as S
from confluence.operators import detectors as D
from confluence.operators import levels as L
from confluence.operators import pivots as P
from confluence.operators import regime as R
from confluence.operators import zones as Z


def tape(spark, closes, high=None, low=None):
    day = datetime.date(2024, 1, 1)
    rows = [("A", day + datetime.timedelta(days=i), float(c), float(high[i] if high else c + 1), float(low[i] if low else c - 1), float(c), 1000.0) for i, c in enumerate(closes)]
    return S.numbered(spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double"))


def values(df, name):
    return [r[name] for r in df.orderBy("date").collect()]


def test_averages_follow_pandas(spark):
    closes = np.exp(np.cumsum(np.random.default_rng(42).normal(0.0005, 0.015, 300))) * 100
    df = tape(spark, closes)
    series = pd.Series(closes)
    got = df.select("date", S.sma(F.col("close"), 20).alias("sma"), S.ema(F.col("close"), 50).alias("ema"))
    np.testing.assert_allclose(np.array(values(got, "sma")[19:]), series.rolling(20).mean()[19:])
    np.testing.assert_allclose(values(got, "ema"), series.ewm(span=50, adjust=False).mean())
    up, down = series.diff().clip(lower=0).fillna(0), (-series.diff()).clip(lower=0).fillna(0)
    a, b = up.ewm(alpha=1 / 14, adjust=False).mean(), down.ewm(alpha=1 / 14, adjust=False).mean()
    rsi = np.where(b == 0, np.where(a > 0, 100.0, 50.0), 100 - 100 / (1 + a / b.where(b != 0, 1)))
    np.testing.assert_allclose(values(S.with_rsi(df), "rsi"), rsi)
    line = series.ewm(span=12, adjust=False).mean() - series.ewm(span=26, adjust=False).mean()
    np.testing.assert_allclose(values(S.with_macd(df), "macd_hist"), line - line.ewm(span=9, adjust=False).mean(), atol=1e-9)


def test_short_and_flat_series(spark):
    assert values(S.with_rsi(tape(spark, [5] * 30)), "rsi") == [50.0] * 30
    assert values(S.with_rsi(tape(spark, range(10, 40))), "rsi")[1:] == [100.0] * 29
    assert values(tape(spark, range(1, 6)).select("date", S.sma(F.col("close"), 10).alias("x")), "x") == [None] * 5
    assert set(values(S.with_macd(tape(spark, [7] * 40)), "macd_state")) == {"neutral"}


def test_v_shape_has_one_pivot_low(spark):
    closes = [112 - i for i in range(12)] + [102 + i for i in range(13)]
    df = tape(spark, closes, high=[c + 0.5 for c in closes], low=[c - 0.5 for c in closes]).withColumn("atr", F.lit(2.0))
    assert [(r.kind, r.rn) for r in P.pivots(df).collect()] == [("low", 11)]
    assert P.pivots(tape(spark, range(1, 60)).withColumn("atr", F.lit(2.0))).count() == 0
    assert P.pivots(tape(spark, [1, 2, 3]).withColumn("atr", F.lit(1.0))).count() == 0


def test_long_series_lose_no_bar(spark):
    """Three blocks: every bar stays, and recursive values go on across block ends."""
    closes = np.exp(np.cumsum(np.random.default_rng(7).normal(0, 0.01, 7000))) * 100
    df, series = tape(spark, closes), pd.Series(closes)
    got = df.select("date", S.ema(F.col("close"), 200).alias("ema"), S.ewm(F.col("close"), 2 / 13).alias("fast"))
    np.testing.assert_allclose(values(got, "ema"), series.ewm(span=200, adjust=False).mean(), rtol=1e-9)
    np.testing.assert_allclose(values(got, "fast"), series.ewm(span=12, adjust=False).mean(), rtol=1e-9)
    assert S.as_of(df, "2024-03-01").count() == 61 and S.as_of(df, None).count() == 7000


def levelled(spark, rows):
    """Bars from (close, high, low) with the context that levels need."""
    closes, high, low = (list(x) for x in zip(*rows))
    return L.context(S.with_atr(tape(spark, closes, high=high, low=low)))


def test_a_gap_into_the_window_does_not_count(spark):
    """252 bars are looked at: a gap between the first of them and the bar before is outside, the next one inside."""
    flat = lambda n, at: [(at, at + 0.5, at - 0.5)] * n
    edge = flat(8, 100.0) + flat(252, 110.0)
    inside = flat(9, 100.0) + flat(251, 110.0)
    assert L.gaps(levelled(spark, edge)).count() == 0
    assert [(r.element, r.price) for r in L.gaps(levelled(spark, inside)).collect()] == [("gap_unfilled", 105.0)]


def pivots_of(spark, rows, top, spot):
    """Pivots (rn, kind, price) of a series whose last bar is ``top``."""
    day = datetime.date(2024, 1, 1)
    full = [("A", day + datetime.timedelta(days=rn), rn, kind, price, 1.0, None, None, float(top), spot, 1.0) for rn, kind, price in rows]
    return spark.createDataFrame(full, "symbol string, date date, rn int, kind string, price double, atr double, rsi double, macd_hist double, top double, spot double, last_atr double")


def test_a_low_exactly_180_bars_back_counts(spark):
    bars = levelled(spark, [(100.0, 120.0, 90.0)] * 260)
    for first, found in ((79, 1), (78, 0)):
        lows = pivots_of(spark, [(first, "low", 90.0), (first + 30, "low", 90.5)], 259, 100.0)
        assert D.double_bottom(bars, lows).count() == found


def test_an_old_pivot_low_anchors_nothing(spark):
    bars = levelled(spark, [(100.0, 101.0, 99.0)] * 400)
    for rn, found in ((147, 0), (148, 1)):
        got = L.anchors(pivots_of(spark, [(rn, "low", 99.0)], 399, 100.0), bars)
        assert got.filter("element = 'avwap_pivot_low'").count() == found


def test_zone_bounds_lie_a_share_of_the_centre_outside(spark):
    rows = [("A", "sma_200d", 90.0, 1, None, 100.0, 5.0, "support"), ("A", "hvn", 90.9, 1, "1-2", 100.0, 5.0, "support"), ("A", "divergence", 90.5, 1, "both", 100.0, 5.0, "support")]
    z = Z.zones(Z.clustered(spark.createDataFrame(rows, "symbol string, element string, price double, rn long, detail string, spot double, last_atr double, side string"))).first()
    np.testing.assert_allclose([z.lower, z.upper, z.center], [90 - 0.09045, 90.9 + 0.09045, 90.45])
    assert z.signals == ["both"] and z.elements == ["sma_200d", "divergence", "hvn"]


def test_levels_can_be_added(spark):
    bars = levelled(spark, [(100.0 + i % 7, 101.0 + i % 7, 99.0 + i % 7) for i in range(60)])
    L.register_level("half", lambda found, bars: bars.filter("rn = top").select("symbol", F.lit("half").alias("element"), (F.col("spot") / 2).alias("price"), F.col("rn").cast("long").alias("rn"), F.lit(None).cast("string").alias("detail"), "spot", "last_atr"))
    try:
        weeks = S.numbered(S.weekly(bars))
        assert L.all_levels(bars, weeks, P.pivots(bars)).filter("element = 'half' and side = 'support'").count() == 1
    finally:
        L.EXTRA.clear()


def test_capitulation_at_its_real_thresholds(spark):
    """A fall of 15 % in ten bars, a wide and heavy bar that closes high, and a close above it with no new low."""
    calm = [(100.0, 101.0, 99.0, 1000.0)] * 40
    fall = [(100.0 - 1.5 * i, 101.0 - 1.5 * i, 99.0 - 1.5 * i, 1000.0) for i in range(1, 11)]
    climax, after = [(84.0, 85.0, 72.0, 9000.0)], [(83.0, 84.0, 82.0, 1000.0)] * 2 + [(86.0, 87.0, 83.0, 1000.0)] * 20
    rows = calm + fall + climax + after
    day = datetime.date(2024, 1, 1)
    frame = [("A", day + datetime.timedelta(days=i), c, h, low, c, v) for i, (c, h, low, v) in enumerate(rows)]
    bars = L.context(S.with_atr(S.numbered(spark.createDataFrame(frame, "symbol string, date date, open double, high double, low double, close double, volume double"))))
    assert [(r.climax_rn, r.reclaim_rn) for r in D.capitulation(bars).collect()] == [(50, 53)]


def test_dips_at_the_real_threshold_and_earnings_ahead(spark):
    closes = [100.0] * 30 + [99.0, 94.9] + [95.0] * 10
    bars = L.context(S.with_atr(tape(spark, closes)))
    events = spark.createDataFrame([("A", datetime.date(2024, 1, 30))], "symbol string, date date")
    assert R.post_earnings_dip(bars, events).count() == 1
    assert R.post_earnings_dip(bars, events, upcoming=events).count() == 0


def test_labels_and_first_generation_types(spark):
    facts = spark.createDataFrame([("A", "reversal", True, True), ("B", "downtrend", False, False)], "symbol string, regime string, hma_weekly_flip boolean, bullish_divergence boolean")
    for name, _, _ in C.TRIGGERS:
        if name not in facts.columns:
            facts = facts.withColumn(name, F.lit(None).cast("boolean"))
    a, b = R.classified(facts).orderBy("symbol").collect()
    assert (a.primary_trigger, a.legacy, a.label, a.triggers) == ("hma_weekly_flip", "T2", "Reversal: Cambio de régimen + divergencia", "hma_weekly_flip|bullish_divergence")
    assert (b.primary_trigger, b.legacy, b.label) == (None, None, "Downtrend: sin trigger")

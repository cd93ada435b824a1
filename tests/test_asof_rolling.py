"""As-of joins and order statistics of sliding windows against plain code; maxima of ranges behind double bottoms."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from confluence import config as C
from confluence.functions import rolling
from confluence.operators import asof
from confluence.operators import detectors as D


def plain_join(left, right, exact):
    out = []
    for k, t, i in left:
        hits = [(rt, v, w) for rk, rt, v, w in right if k is not None and t is not None and rk == k and rt is not None and (rt <= t if exact else rt < t)]
        out.append((k, t, i, *(max(hits, key=lambda h: (h[0], h[1] is not None, h[1] or 0, h[2]))[1:] if hits else (None, None))))
    return sorted(out, key=str)


@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("span", [1, 7, 100, 10_000])
def test_asof_join(spark, span, exact):
    rng = random.Random(span)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", "only left", None])
    time = lambda: rng.choice([None] + list(range(-300, 300)))
    left = [(key(), time(), i) for i in range(300)]
    left += left[:20]  # repeated rows stay
    right = [(k, time(), rng.choice([None, 1, 2, 3]), i) for i in range(150) if (k := key()) != "only left"]
    right += [(k, t, 2, 1000 + i) for i, (k, t, _, _) in enumerate(right[:40])]  # ties in time
    a, b = spark.createDataFrame(left, "k string, t int, i int"), spark.createDataFrame(right, "k string, t int, v int, w int")
    got = asof.join(a, b, "k", "t", span, exact=exact)
    assert got.columns == ["k", "t", "i", "v", "w"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_join(left, right, exact)


def test_asof_join_of_empty_sides_times_and_clashes(spark):
    day = datetime.date
    a = spark.createDataFrame([("x", day(1969, 12, 31)), ("x", day(2024, 1, 5))], "k string, d date")
    b = spark.createDataFrame([("x", day(1969, 1, 1), 1.0)], "k string, d date, v double")
    assert sorted(r.v for r in asof.join(a, b, "k", "d", 30).collect()) == [1.0, 1.0]
    assert [r.v for r in asof.join(a, b.limit(0), "k", "d", 30).collect()] == [None, None]
    assert asof.join(a.limit(0), b, "k", "d", 30).count() == 0
    stamps = lambda df: df.withColumn("d", F.col("d").cast("timestamp"))
    assert sorted(r.v for r in asof.join(stamps(a), stamps(b), "k", "d", 3600.0).collect()) == [1.0, 1.0]
    with pytest.raises(ValueError, match="both sides: v"):
        asof.join(b, b, "k", "d", 30)


def test_a_hot_key_spreads_over_groups(spark):
    a = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("t"))
    b = spark.range(0, 4000, 50).select(F.lit("hot").alias("k"), F.col("id").alias("t"), F.col("id").alias("v"))
    got = asof.join(a, b, "k", "t", 100)
    assert got.filter("v <> floor(t / 50) * 50 or v is null").count() == 0
    assert "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n, block", [(1, 16), (7, 16), (40, 16), (252, 4096)])
def test_order_statistics(spark, n, block, monkeypatch):
    monkeypatch.setattr(rolling, "BLOCK", block)
    rng = random.Random(n)
    rows = [(s, i, rng.choice([None, float("nan"), 1.0, 2.0, rng.random()])) for s, m in (("a", 300), ("b", 5)) for i in range(m)]
    df = spark.createDataFrame(rows, "symbol string, rn int, x double").withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("rn")))
    got = {(r.symbol, r.rn): r for r in rolling.order_statistics(df, "x", n, 0.8).collect()}
    assert len(got) == len(rows)
    for s, i, x in rows:
        held = [v for t, j, v in rows if t == s and i - n < j <= i and v is not None and v == v]
        r = got[s, i]
        assert r.n == len(held)
        assert r.percentile is None if not held else r.percentile == pytest.approx(np.quantile(held, 0.8))
        assert r.share is None if x is None or x != x else r.share == pytest.approx(sum(v <= x for v in held) / len(held))
    assert rolling.order_statistics(df.limit(0), "x", n).count() == 0


def test_double_bottoms_of_random_pivots(spark):
    rng, bars, found, expected = random.Random(3), [], [], {}
    for s in range(12):
        top, highs = 259, [100 + 20 * rng.random() for _ in range(260)]
        pivots = [(rn, rng.choice(["low", "low", "high"]), 90 + 6 * rng.random() if rng.random() < 0.8 else 110.0) for rn in sorted(rng.sample(range(260), 30 if s else 4))]
        bars += [(str(s), rn, h, top) for rn, h in enumerate(highs)]
        found += [(str(s), rn, kind, price, top, 105.0) for rn, kind, price in pivots]
        lows = [(rn, p) for rn, kind, p in pivots if kind == "low" and rn >= top - C.DOUBLE_BOTTOM_BARS]
        best = None
        for i, (r1, p1) in enumerate(lows):
            for r2, p2 in lows[i + 1 :]:
                if not (C.DOUBLE_BOTTOM_GAP[0] <= r2 - r1 <= C.DOUBLE_BOTTOM_GAP[1]) or abs(p2 - p1) / p1 >= C.DOUBLE_BOTTOM_TOLERANCE:
                    continue
                neck = max((p for rn, kind, p in pivots if kind == "high" and r1 < rn < r2), default=max(highs[r1 : r2 + 1]))
                if (neck - min(p1, p2)) / min(p1, p2) >= C.DOUBLE_BOTTOM_BOUNCE and (best is None or (r2, -r1) > (best[1], -best[0])):
                    best = (r1, r2, neck)
        if best:
            expected[str(s)] = best
    b = spark.createDataFrame(bars, "symbol string, rn int, high double, top int")
    f = spark.createDataFrame(found, "symbol string, rn int, kind string, price double, top int, spot double")
    got = {r.symbol: (r.l1_rn, r.l2_rn, r.neckline) for r in D.double_bottom(b, f).collect()}
    assert got == expected and len(expected) > 5

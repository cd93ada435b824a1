"""Many days at once against one day at a time; profiles, formats and rounding at their edges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from confluence import config as C
from confluence.functions import series as S
from confluence.functions import strikes as K
from confluence.functions.text import fixed
from confluence.operators import as_of as A
from confluence.operators import levels as L
from confluence.operators import pivots as P
from confluence.operators import profile as V
from confluence.operators import zones as Z

SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double"


def walk(spark, n, seed=1, symbols=("A", "B@C"), volume=None):
    """Random series of different lengths from 2020-01-01 on."""
    rng, rows = random.Random(seed), []
    for k, symbol in enumerate(symbols):
        price = 100.0
        for i in range(n - 40 * k):
            last, price = price, price * (1 + rng.gauss(0, 0.02))
            spread = abs(rng.gauss(0, 0.01)) * price * (rng.random() > 0.05)
            rows.append((symbol, i, last, max(last, price) + spread if spread else price, min(last, price) - spread if spread else price, price, float(rng.randint(1, 1000)) if volume is None else volume(i)))
    df = spark.createDataFrame(rows, SCHEMA.replace("date date", "i int"))
    return df.select("symbol", F.date_add(F.lit("2020-01-01").cast("date"), F.col("i")).alias("date"), "open", "high", "low", "close", "volume")


def plain_nodes(rows):
    """The reference rules over a year's bars, bar by bar and bucket by bucket."""
    bottom, top = min(r.low for r in rows), max(r.high for r in rows)
    width, held = (top - bottom) / 50, [0.0] * 50
    for r in rows:
        if r.high <= r.low:
            held[max(0, min(49, int((r.close - bottom) / width)))] += r.volume
        else:
            for k in range(50):
                held[k] += max(0.0, min(r.high, bottom + (k + 1) * width) - max(r.low, bottom + k * width)) / (r.high - r.low) * r.volume
    dense, out = [v >= np.percentile(held, 80) for v in held] + [False], []
    for k in range(50):
        if dense[k] and (k == 0 or not dense[k - 1]):
            out.append((k, next(j for j in range(k, 51) if not dense[j]) - 1))
    return out, held


@pytest.mark.parametrize("block", [V.BLOCK, 50])
def test_sliding_profiles_are_those_of_single_years(spark, block):
    """The small blocks make series span several of them."""
    bars = S.numbered(walk(spark, 340))
    got = {(r.symbol, r.rn): r for r in V.sliding(bars, block=block).collect()}
    rows = {s: sorted((r for r in bars.collect() if r.symbol == s), key=lambda r: r.rn) for s in ("A", "B@C")}
    assert set(got) == {(s, i) for s, own in rows.items() for i in range(251, len(own))}
    for (s, i), r in got.items():
        if i % 7 == 0:
            nodes, held = plain_nodes(rows[s][i - 251 : i + 1])
            assert np.allclose(r.volumes, held) and [(n["first"], n["last"]) for n in r.nodes] == nodes
    assert "Exchange" in V.sliding(bars)._jdf.queryExecution().executedPlan().toString()


def test_profiles_of_short_flat_and_mostly_empty_series(spark):
    short = S.numbered(walk(spark, 60, symbols=("A",)))
    assert V.sliding(short).count() == 0 and L.volume_nodes(L.volume_profile(L.context(short))).count() == 0
    flat = spark.createDataFrame([("F", i, 5.0, 5.0, 5.0, 5.0, 1.0) for i in range(260)], SCHEMA.replace("date date", "date int")).withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("date")))
    assert V.sliding(S.numbered(flat)).count() == 0
    # volume on one bar only: most buckets are empty and so is the percentile, which all buckets reach
    empty = S.numbered(walk(spark, 252, symbols=("A",), volume=lambda i: 100.0 if i == 251 else 0.0))
    one = V.sliding(empty).collect()
    levels = L.volume_nodes(L.volume_profile(L.context(empty))).collect()
    assert [(n["first"], n["last"]) for n in one[0].nodes] == [(0, 49)] and [r.detail for r in levels] == ["0-49"]


def test_levels_and_zones_of_many_days_are_those_of_single_days(spark):
    bars = S.with_macd(S.with_rsi(S.with_atr(S.numbered(walk(spark, 400, seed=5))))).persist()
    weeks = S.numbered(S.weekly(bars.select("symbol", "date", "open", "high", "low", "close", "volume")))
    events = spark.createDataFrame([(s, f"2020-{m:02d}-10") for s in ("A", "B@C") for m in (2, 5, 8, 11)] + [("A", "2021-02-03"), ("A", "2021-06-20")], "symbol string, date string").withColumn("date", F.col("date").cast("date"))
    step = 30
    shown = lambda df: sorted((r.symbol, r.element, round(r.price, 6), r.rn, r.detail, r.side) for r in df.collect())
    many = shown(A.levels(bars, weeks, P.pivots(bars), step, events))
    zones = {(r.symbol, r.at, r.zone_id): (round(r.lower, 6), round(r.score, 6), r.rejection_reason) for r in A.zones(bars, weeks, P.pivots(bars), step, events).collect()}
    got = 0
    for at in (329, 389):  # both series' lengths are between them or beyond
        own = L.context(bars.filter(F.col("rn") <= at).join(bars.filter(F.col("rn") == at).select("symbol"), "symbol", "left_semi")).persist()
        week = S.numbered(S.weekly(own.select("symbol", "date", "open", "high", "low", "close", "volume")))
        known = events.join(own.groupBy("symbol").agg(F.max("date").alias("day")), "symbol").filter("date <= day").select("symbol", "date")
        found = L.all_levels(own, week, P.pivots(own).persist(), known).persist()
        assert [(f"{s}@{at}", *rest) for s, *rest in shown(found)] == [r for r in many if r[0].endswith(f"@{at}")]
        for r in Z.zones(Z.clustered(found)).collect():
            assert zones[r.symbol, at, r.zone_id] == (round(r.lower, 6), round(r.score, 6), r.rejection_reason)
            got += 1
    assert got > 3


def test_zones_hold_while_no_low_falls_below_the_strike(spark):
    z = spark.createDataFrame([("A", 2, 3, 9.5, 95.0, 97.0, 96.0, 100.0, 2.0, True), ("A", 3, 1, 5.5, 95.0, 97.0, 96.0, 100.0, 2.0, True), ("A", 4, 1, 5.5, 95.0, 97.0, 96.0, 100.0, 2.0, True)], "symbol string, at int, tier int, score double, lower double, upper double, center double, spot double, atr double, is_best boolean")
    bars = spark.createDataFrame([("A", i, low) for i, low in enumerate([100.0, 1.0, 1.0, 94.0, 93.0, 92.9, 99.0])], "symbol string, rn int, low double").withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("rn")))
    found = A.outcomes(z, bars, horizon=2)
    assert {(r.at, r.strike, r.lowest, r.held) for r in found.collect()} == {(2, 93.0, 93.0, True), (3, 93.0, 92.9, False), (4, 93.0, 92.9, False)}
    assert {(r.tier, r.n, r.n_held, round(r.rate, 3)) for r in A.hold_rate(found).collect()} == {(None, 3, 1, 0.333), (3, 1, 1, 1.0), (1, 2, 0, 0.0)}
    assert A.outcomes(z, bars, horizon=3).count() == 2


def test_numbers_are_rounded_by_their_exact_value(spark):
    rng = random.Random(2)
    values = [0.125, 12.25, 2.675, 1.005, 0.0, -0.125, -2.5, 99.995, 0.5, 1.5] + [rng.randrange(10**5) / 8 for _ in range(300)] + [rng.randrange(10**6) / 1000 for _ in range(600)] + [rng.uniform(-1e6, 1e6) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 2):
        assert all(s == f"{x:.{digits}f}" for x, s in df.select("x", fixed(F.col("x"), digits)).collect())
    assert df.limit(1).select(fixed(F.lit(None), 2)).first()[0] is None


def test_reasons_name_their_values(spark):
    z = spark.createDataFrame([(4.0, False, 0.0125, 1), (9.0, True, 0.2, 2), (9.0, True, 0.05, 3), (9.0, True, -0.01, 2)], "score double, dynamic boolean, distance double, n_heavy long")
    near = lambda x: f"zona muy cerca del spot ({x:.1%} < 3%), no accionable para 30-45 DTE"
    far = "fuera de rango de proximidad (>10% o por encima del spot)"
    assert [r[0] for r in z.select(Z.reasons()).collect()] == [f"score < 5.0 | sin confirmador dinámico | {near(0.0125)} | solo 1 elementos peso >= 2.5 (requeridos 2)", far, "", f"{far} | {near(-0.01)}"]


def test_grids_of_prices_up_to_nothing(spark):
    df = spark.createDataFrame([(0.0, "JPY"), (-3.0, "SEK"), (1000.0, "JPY"), (0.0, "USD")], "spot double, currency string")
    assert [r[0] for r in df.select(K.grid(F.col("spot"), F.col("currency"))).collect()] == [0.01, 0.01, 10.0, min(size for _, size in C.GRIDS["USD"])]

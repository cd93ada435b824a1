import datetime

import pytest
from pyspark.sql import functions as F

from confluence.functions import strikes as K
from confluence.operators import events as E
from confluence.operators import filters as R
from confluence.operators import history as H
from confluence.operators import report as P
from confluence.operators import universe as U
from confluence.operators import zones as Z
from confluence.operators.narrative import narrative
from confluence.sources import federation as S
from confluence.sources import projections as J


def test_strikes_follow_the_grid(spark):
    df = spark.createDataFrame([(93.0, 95.0, 94.0, 100.0, 2.0)], "lower double, upper double, center double, spot double, atr double")
    row = df.select(*[c.alias(n) for n, c in K.strikes(*[F.col(c) for c in df.columns], F.lit("USD")).items()]).first()
    assert tuple(row) == (98.0, 94.0, 91.0)


@pytest.mark.parametrize(("score", "tier"), [(18.0, 5), (17.9, 4), (13.0, 4), (9.0, 3), (6.5, 2), (5.0, 1), (0.0, 1)])
def test_tiers(spark, score, tier):
    assert spark.range(1).select(Z.tier(F.lit(score)).alias("t")).first().t == tier


def candidate(spark, **changes):
    base = {"market_cap": 2e10, "avg_volume": 2e6, "free_cash_flow": 1.0, "sector": "Technology", "country": "United States", "upside": 0.1, "buy_ratio": 0.5, "downgrades": 0, "rsi_daily": 40.0, "rsi_weekly": 40.0, "hv_percentile": 50.0} | changes
    kinds = "market_cap double, avg_volume double, free_cash_flow double, sector string, country string, upside double, buy_ratio double, downgrades int, rsi_daily double, rsi_weekly double, hv_percentile double"
    return R.screened(spark.createDataFrame([tuple(base.values())], kinds)).first()


@pytest.mark.parametrize(
    ("changes", "rules"),
    [({}, []), ({"market_cap": None}, ["quality_liquidity"]), ({"free_cash_flow": -1.0}, ["quality_liquidity"]), ({"free_cash_flow": -1.0, "sector": "Utilities"}, []), ({"buy_ratio": 0.44}, ["valuation"]), ({"buy_ratio": 0.45}, []), ({"upside": 0.0}, ["valuation"]),
     ({"downgrades": 2}, ["valuation"]), ({"downgrades": 2, "country": "Spain"}, []), ({"rsi_weekly": 70.0}, ["momentum"]), ({"hv_percentile": 90.1, "avg_volume": 1.0}, ["quality_liquidity", "hv_percentile"])],
)
def test_every_failing_rule_is_named(spark, changes, rules):
    row = candidate(spark, **changes)
    assert [r.split(":")[0] for r in row.reasons] == rules and row.passed == (not rules)


@pytest.mark.parametrize(("country", "passes"), [("United States", False), ("Canada", False), (None, False), ("Finland", True), ("Bermuda", True), ("GB", True), ("US", False)])
def test_rating_cuts_count_where_they_are_known(spark, country, passes):
    row = candidate(spark, downgrades=3, country=country)
    assert row.passed == passes and (passes or row.reasons == ["valuation: 3 downgrades en 6w > 1"])


def test_reasons_tell_values(spark):
    assert candidate(spark, market_cap=5e9).reasons == ["quality_liquidity: market cap (5000000000.0) < 10000000000"]
    assert candidate(spark, avg_volume=None).reasons == ["quality_liquidity: avg daily volume (None) < 1000000"]
    assert candidate(spark, upside=-0.012).reasons == ["valuation: price target upside (-1.2%) ≤ 0.0%"]
    assert candidate(spark, rsi_daily=71.25, hv_percentile=None).reasons == ["momentum: RSI_d sobrecomprado (71.2 ≥ 70.0)", "hv_percentile: HV percentile None < 30.0"]


def test_rules_can_be_added(spark):
    R.register_filter("size", lambda: F.when(F.col("sector") == "Technology", "no technology"))
    try:
        assert candidate(spark).reasons == ["size: no technology"]
    finally:
        del R.RULES["size"]


def test_state_predicate_treats_nulls_as_absent(spark):
    kinds = "symbol string, regime string, primary_trigger string, sector string, score double, earnings_near boolean, ex_div_near boolean, macro_near boolean, wheel boolean"
    df = spark.createDataFrame([("A", "uptrend", None, "x", None, True, False, None, True), ("B", None, "range_floor", None, 9.0, False, True, True, None)], kinds)
    left = lambda **asked: [r.symbol for r in df.filter(R.state_predicate(**asked)).orderBy("symbol").collect()]
    assert left() == ["A", "B"] and left(score_min=5) == ["B"] and left(sectors=("x",)) == ["A"] and left(regimes=("uptrend", "lateral")) == ["A"]
    assert left(triggers=("range_floor",)) == ["B"] and left(earnings=False) == ["B"] and left(ex_div=False) == ["A"] and left(macro=True) == ["B"] and left(macro=False) == []
    assert left(wheel_only=True) == ["A"] and left(wheel_only=True, earnings=False) == []
    assert [r.sector for r in R.sectors(df).collect()] == ["x"]


def test_events_of_the_past_are_not_near(spark):
    own, day = spark.createDataFrame([("A",)], "symbol string"), F.lit("2024-01-10").cast("date")
    past = own.select("symbol", F.lit("2024-01-01").cast("date").alias("date"), F.lit(1.0).alias("amount"))
    none = S.macro_calendar(spark, [{"date": "2024-06-01", "kind": "cpi"}])
    row = E.binary_events(own, past, past, none, day).first()
    assert (row.days_to_earnings, row.earnings_near, row.has_events, row.flags) == (-9, False, False, "")
    with pytest.raises(ValueError, match="unknown kind"):
        S.macro_calendar(spark, [{"date": "2024-06-01", "kind": "party"}])


def test_upsert_fallback_and_history(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, S.merged(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert {(r.k, r.source) for r in S.resolved({"old": old, "new": new}, ["k"]).collect()} == {(1, "old"), (2, "old"), (3, "new")}
    path = str(tmp_path / "runs")
    H.save(old.withColumn("run_id", F.lit("r1")), path)
    H.save(new.withColumn("run_id", F.lit("r2")), path)
    H.save(new.withColumn("run_id", F.lit("r1")), path)
    assert H.load(spark, path).count() == 4


def test_watchlist_prices_and_words(spark):
    lines = spark.createDataFrame([("# c",), ("aa b",), (" brk.b ",), (None,)], "value string")
    assert {tuple(r) for r in U.watchlist(lines).collect()} == {("AA B", False), ("BRK.B", True)}
    row = spark.range(1).select(P.format_price(F.lit(12.5), F.lit("EUR")).alias("a"), P.format_price(F.lit(3.0), F.lit("?")).alias("b"), P.short_number(F.lit(3.4e6)).alias("c"), P.stars(F.lit(2)).alias("d")).first()
    assert tuple(row) == ("€12.50", "$3.00", "3.4M", "⭐⭐")


def test_prices_by_currency_and_country(spark):
    price = lambda c: P.format_price(F.lit(42.0), F.lit(c))
    row = spark.range(1).select(*[price(c) for c in ("CHF", "JPY", "GBp", "NOK", None)], *[P.currency_of(F.lit(c)) for c in ("Finland", "Belgium", "Austria", "Portugal", "United Kingdom", "Peru", None)]).first()
    assert tuple(row) == ("42.00 CHF", "¥42.00", "42.00p", "42.00 kr", "$42.00", "EUR", "EUR", "EUR", "EUR", "GBp", "USD", "USD")


def test_flags_say_dividends_in_their_currency(spark):
    own = spark.createDataFrame([("A", "CHF"), ("B", None)], "symbol string, currency string")
    day = F.lit("2024-01-10").cast("date")
    near = own.select("symbol", F.lit("2024-01-20").cast("date").alias("date"), F.when(F.col("symbol") == "A", 1.5).alias("amount"))
    rows = E.binary_events(own, near.limit(0), near, S.macro_calendar(spark, [{"date": "2024-02-01", "kind": "other"}]), day).orderBy("symbol").collect()
    assert [r.flags for r in rows] == ["Ex-dividend en 10 días (1.50 CHF)", "Ex-dividend en 10 días"] and rows[0].macro_kinds == "other"
    assert E.macro_banner(S.macro_calendar(spark, [{"date": "2024-02-01", "kind": "other"}]), day).first().jurisdiction == "—"


def test_sources_fall_back_and_caches_stand(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "b")], "k int, v string")

    def broken():
        raise S.SourceError

    S.register_reader("primary", "profile", lambda: a)
    S.register_reader("fallback", "profile", lambda: b)
    S.register_reader("primary", "earnings", broken)
    S.register_reader("fallback", "earnings", lambda: b)
    try:
        assert S.supports("primary", "profile") and not S.supports("fallback", "dividends")
        assert {(r.k, r.v) for r in S.read("profile", ["k"]).collect()} == {(1, "a"), (2, "b")}
        assert {r.source for r in S.read("earnings", ["k"]).collect()} == {"fallback"}
        with pytest.raises(S.SourceError):
            S.read("dividends", ["k"])
    finally:
        S.READERS.clear()
    bars = spark.createDataFrame([("A", i, 1.0) for i in range(10)], "symbol string, date int, close double")
    got = S.refreshed(bars, lambda: bars.withColumn("close", F.lit(2.0)), ["symbol", "date"])
    assert sorted(r.date for r in got.filter("close = 2").collect()) == list(range(3, 10)) and got.count() == 10
    assert S.refreshed(bars, broken, ["symbol", "date"]).filter("close = 1").count() == 10
    path = str(tmp_path / "cache")
    assert not S.write_cache(bars, path, enabled=False) and S.write_cache(bars, path) and spark.read.parquet(path).count() == 10
    now = datetime.datetime.now() + datetime.timedelta(hours=5)
    assert S.fresh_files(spark, path, "parquet", 6, now).count() == 10 and S.fresh_files(spark, path, "parquet", 4, now).count() == 0


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,100\nNo data,,,,,\n")
    (tmp_path / "b.csv").write_text("No data\n")
    assert [tuple(r)[1:] for r in S.price_csv(spark, str(tmp_path / "a.csv")).collect()] == [(1.0, 2.0, 0.5, 1.5, 100.0)]
    with pytest.raises(S.SourceError):
        S.price_csv(spark, str(tmp_path / "b.csv"))
    (tmp_path / "m.json").write_text('[{"date": "2024-06-01", "kind": "cpi"}]')
    (tmp_path / "n.json").write_text('[{"date": "2024-06-01", "kind": "party"}]')
    assert S.macro_file(spark, str(tmp_path / "m.json")).first().description == ""
    with pytest.raises(ValueError, match="party"):
        S.macro_file(spark, str(tmp_path / "n.json"))


def test_tables_symbols_and_universes(spark):
    page = "<table><tr><th>X</th></tr></table><table><tr><th>Name</th><td>Symbol</td></tr><tr><td>a</td><td><b>AA</b>\n B</td></tr><tr><td>short</td></tr><tr><td>c</td><td> </td></tr></table>"
    df = spark.createDataFrame([(1, page), (2, "<p>none</p>"), (3, None)], "page_id int, html string")
    assert [tuple(r) for r in U.table_column(df, ("Ticker", "Symbol")).collect()] == [(1, 0, "AAB")]
    assert U.chosen(" SP500, ,watchlist", ("sp500", "watchlist")) == ["sp500", "watchlist"]
    for bad in ("", "sp500,mars"):
        with pytest.raises(ValueError, match="unknown universes"):
            U.chosen(bad, ("sp500",))
    row = spark.range(1).select(U.quoted(F.lit("VOD.L")), U.quoted(F.lit("X.ZZ")), U.by_country(F.lit("a b"), F.lit("Luxembourg")), U.by_market(F.lit("NOVO B DC"))).first()
    assert tuple(row) == ("vod.uk", None, "A-B.AS", "NOVO B.CO")


def test_projections(spark):
    lines = spark.createDataFrame([('{"symbol": "A", "date": "2024-01-02"}',), ("{broken",)], "value string")
    assert [tuple(map(str, r)) for r in J.from_cache(lines, "symbol string, date date").collect()] == [("A", "2024-01-02")]
    raw = spark.createDataFrame([("A", "Alpha", None, "", "US", "12.5"), ("B", None, "B", None, None, "x")], "symbol string, long_name string, short_name string, sector string, country string, market_cap string")
    assert [tuple(r) for r in J.profile(raw, in_millions=True).collect()] == [("A", "Alpha", None, "US", 12.5e6)]
    row = spark.range(1).select(J.rating_action(F.lit(" Main ")), J.rating_action(F.lit("Odd")), J.rating_action(F.lit("Odd"), keep_case=True), J.rating_action(F.lit(None).cast("string")), J.clean_count(F.lit("3.9")), J.recommendation_mean([F.lit(x) for x in (1, 0, 0, 0, 1)])).first()
    assert tuple(row) == ("reiterated", "odd", "Odd", "", 3, 3.0)


def test_report_files_are_written_twice(spark, tmp_path):
    rows = spark.createDataFrame([("A", None, ["x", "y"])], "ticker string, note string, held array<string>")
    for path in P.write_csv(rows, str(tmp_path), "2024-01-02", "0930"):
        assert [tuple(r) for r in spark.read.option("header", True).csv(path).collect()] == [("A", None, "x | y")]


def test_narrative_leaves_out_what_isnt_known(spark):
    names = "symbol string, legacy string, rsi_daily double, rsi_daily_3_ago double, macd_state string, elements array<string>, lower double, upper double, center double, width_pct double, distance double, spot double, atr double, currency string, earnings_near boolean, days_to_earnings int, ex_div_near boolean, days_to_ex_div int, ex_div_amount double, macro_near boolean, macro_kinds string"
    base = ("A", None, 40.0, 35.0, "neutral", ["hvn"], 90.0, 92.0, 91.0, 0.022, 0.09, 100.0, 2.0, "USD", False, None, False, None, None, False, "")
    full = ("A", "T1", 40.0, 35.0, "subiendo_positivo", ["avwap_earnings", "sma_200d", "avwap_pivot_low", "ema_200d"], 90.0, 92.0, 91.0, 0.012, 0.05, 100.0, 2.0, "EUR", True, 10, True, 5, None, True, "cpi, fomc")
    text = lambda row: spark.createDataFrame([row], names).select(narrative().alias("t")).first().t
    calm = text(base).split("\n")
    assert len(calm) == 2 and calm[0] == "<p><strong>Zona.</strong> La zona detectada está en $90.00 – $92.00 (ancho 2.2%, ajustada). El precio está a 9.0% del techo de la zona, al límite del rango operable.</p>"
    assert calm[1].endswith("Sin eventos binarios ni macro en ventana — situación técnica limpia.</p>") and "conservative ($88.00)" in calm[1]
    told = text(full).split("\n")
    assert told[0] == "<p><strong>Situación.</strong> A está en un contexto <strong>T1</strong> (tendencia alcista intacta con pullback a soporte). RSI diario en 40 con giro al alza desde 35. MACD virando a positivo.</p>"
    assert "Anclada en 2 elementos heavy: el AVWAP desde earnings como precio promedio de acumulación reciente; la SMA200 como referencia institucional de largo plazo." in told[1]
    assert "Ex-dividend en 5 días — riesgo" in told[2] and "Eventos macro en ventana: cpi, fomc." in told[2]
    assert text((*base[:8], None, *base[9:])) == ""

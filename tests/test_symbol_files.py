"""The data source of one file a symbol."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from confluence.sources import symbol_files as X

DAYS = "Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,10\n2024-01-03,1.5,2.5,1,2,20\n2024-01-05,2,3,1.5,2.5,30\n2024-01-08,2.5,4,2,3,40\n2024-02-01,3,5,2.5,4,50\n"


@pytest.fixture()
def folder(tmp_path):
    days = tmp_path / "ohlcv" / "d"
    days.mkdir(parents=True)
    (days / "AAA.csv").write_text(DAYS)
    (days / "B%2FB.csv").write_text("Date,Close\n2024-01-03,7\n,8\n")
    (days / "_SUCCESS").write_text("")
    profiles = tmp_path / "profile"
    profiles.mkdir()
    (profiles / "AAA.json").write_text(json.dumps({"name": "Triple A", "sector": "Utilities", "market_cap_usd": 1e9, "more": [1]}) + "\n")
    return tmp_path


def rows(df):
    return [(r.symbol, str(r.date), r.close) for r in df.orderBy("symbol", "date").collect()]


def test_a_scan_reads_symbols_and_days_that_are_asked_for(spark, folder):
    df = X.scan(spark, str(folder))
    assert df.schema.simpleString() == "struct<symbol:string,date:date,open:double,high:double,low:double,close:double,volume:double>"
    assert rows(df) == [("AAA", "2024-01-02", 1.5), ("AAA", "2024-01-03", 2.0), ("AAA", "2024-01-05", 2.5), ("AAA", "2024-01-08", 3.0), ("AAA", "2024-02-01", 4.0), ("B/B", "2024-01-03", 7.0)]
    assert df.rdd.getNumPartitions() == 2
    one = df.filter((F.col("symbol") == "AAA") & (F.col("date") > "2024-01-03") & (F.col("date") <= "2024-01-08"))
    plan = spark._jvm.PythonSQLUtils.explainString(one._jdf.queryExecution(), "formatted")
    assert "PushedFilters: [EqualTo(symbol,AAA), GreaterThan(date,2024-01-03), LessThanOrEqual(date,2024-01-08)]" in plan and "Condition : (date" not in plan
    assert rows(one) == [("AAA", "2024-01-05", 2.5), ("AAA", "2024-01-08", 3.0)] and one.rdd.getNumPartitions() == 1
    assert rows(df.filter((F.col("date") == "2024-01-03") & (F.col("close") > 5))) == [("B/B", "2024-01-03", 7.0)]
    assert rows(df.filter(F.col("symbol").isin("AAA", "ZZZ") & (F.col("date") < "2024-01-03"))) == [("AAA", "2024-01-02", 1.5)]
    assert rows(df.filter("symbol = 'AAA' and symbol = 'B/B'")) == [] == rows(df.filter("symbol = 'none'"))
    assert rows(X.scan(spark, str(folder), symbols="B/B, none")) == [("B/B", "2024-01-03", 7.0)]


def test_weeks_and_months_come_from_days_or_from_their_own_files(spark, folder):
    weeks = X.scan(spark, str(folder), interval="1wk").filter("symbol = 'AAA'")
    assert [(str(r.date), r.open, r.high, r.low, r.close, r.volume) for r in weeks.collect()] == [("2024-01-05", 1, 3, 0.5, 2.5, 60), ("2024-01-12", 2.5, 4, 2, 3, 40), ("2024-02-02", 3, 5, 2.5, 4, 50)]
    months = X.scan(spark, str(folder), interval="1mo").filter("symbol = 'AAA' and date > '2024-01-15'")
    assert [(str(r.date), r.close, r.volume) for r in months.collect()] == [("2024-01-31", 3.0, 100.0), ("2024-02-29", 4.0, 50.0)]
    own = folder / "ohlcv" / "w"
    own.mkdir()
    (own / "AAA.csv").write_text("Date,Close\n2024-01-05,99\n")
    assert rows(X.scan(spark, str(folder), interval="1wk")) == [("AAA", "2024-01-05", 99.0)]
    with pytest.raises(Exception, match="unsupported interval"):
        X.scan(spark, str(folder), interval="1h").collect()


def test_other_entities_have_their_own_schema(spark, folder):
    df = X.scan(spark, str(folder), "profile")
    assert [(r.symbol, r.name, r.sector, r.market_cap_usd, r.country) for r in df.collect()] == [("AAA", "Triple A", "Utilities", 1e9, None)]
    assert X.supports(str(folder), "profile") and not X.supports(str(folder), "financials")
    with pytest.raises(ValueError):
        X.supports(str(folder), "prices")
    with pytest.raises(Exception, match="no financials"):
        X.scan(spark, str(folder), "financials").collect()


def test_symbols_without_data_fail_or_are_skipped(spark, folder):
    (folder / "ohlcv" / "d" / "EMPTY.csv").write_text("No data")
    with pytest.raises(Exception, match="no data for EMPTY"):
        X.scan(spark, str(folder)).collect()
    assert len(rows(X.scan(spark, str(folder), errors="skip"))) == 6
    assert len(rows(X.scan(spark, str(folder)).filter("symbol = 'AAA'"))) == 5


def test_what_is_written_is_read_back(spark, tmp_path):
    df = spark.createDataFrame([(s, datetime.date(2024, 1, d), 1.0, 2.0, 0.5, d + 0.25, 3.0) for s in ("X Y", "Z=1/2") for d in (3, 2, 4)], X.schema_of("ohlcv"))
    for _ in range(2):  # a second write replaces the first
        X.write_series(df, str(tmp_path))
    assert sorted(map(tuple, X.scan(spark, str(tmp_path)).collect())) == sorted(map(tuple, df.collect()))

import datetime
import math

import duckdb
import pytest

from confluence.plans import catalog

catalog.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = (
    "tape_bars", "weekly_bars", "sma_daily", "rsi_daily", "macd_hist", "atr_14", "hv_percentile", "hma_weekly", "pivots", "levels_hvn", "levels_gap", "volume_profile",
    "binary_events", "universe_tags", "downgrades_6w", "source_fallback", "upsert_merge", "candidates_best_zone", "history_pairs", "svg_points", "strike_grid",
    "cleaned_fields", "recommendations_latest", "upcoming_events", "table_column_extract", "run_labels", "filter_state", "filter_state_open", "quote_symbols", "macro_json", "statement_latest",
    "zones", "levels_all", "trigger_facts", "double_bottom_as_of", "step1_reasons", "narrative_text", "mini_chart",
    "constituents", "hv_percentile_daily", "volume_percentile_daily", "weekly_on_daily", "price_before_shipment", "double_bottom",
    "macro_window", "macro_banner", "normalize_symbols", "watchlist_parse",
)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return str(v)[:10] if isinstance(v, datetime.date) else v


def test_every_query_of_the_catalog_is_callable():
    assert len(catalog.QUERIES) >= 70 and set(catalog.SQL) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_spark_and_duckdb_agree(spark, duck, data, name):
    df = catalog.QUERIES[name](spark, data)
    rel = duck.execute(catalog.SQL[name])
    columns = [c[0] for c in rel.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    expected = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in rel.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str) == expected

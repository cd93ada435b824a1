"""The screening run: candidates through step 1, support zones, classification and events, to report rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from confluence.functions import strikes as K
from confluence.functions.text import fixed
from confluence.operators import filters as R
from confluence.operators import report as O
from confluence.operators import zones as Z

#: The report's columns, in order: fixed values.
CSV_COLUMNS = (
    "ticker", "exchange", "sector", "country", "market_cap", "composite_label", "justificacion_tipo", "spot", "zona_min", "zona_max", "zona_centro", "distancia_pct",
    "score_soporte", "n_elementos", "elementos_score", "confirmador_dinamico", "rsi_diario", "rsi_semanal", "macd_estado", "momentum_score", "sma50w_sobre_sma200w",
    "hv_percentile_52w", "price_target_consensus", "price_target_upside_pct", "recommendation_mean", "recommendation_buy_ratio", "downgrades_6w", "earnings_date",
    "dias_a_earnings", "earnings_en_45d", "ex_div_date", "dias_a_ex_div", "ex_div_en_45d", "ex_div_amount", "eventos_macro_en_45d", "eventos_macro_count",
    "tiene_eventos_binarios", "flags_legibles", "fetched_at", "universes", "momentum_signals", "strike_aggressive", "strike_natural", "strike_conservative", "regime",
    "primary_trigger", "triggers", "wheel_candidate",
)


def selected(candidates: DataFrame, zones: DataFrame, classes: DataFrame, events: DataFrame) -> DataFrame:
    """Every candidate with the facts of all steps and ``in_step1``, ``in_step2`` (passed and with a best zone), ``in_step3`` (and
    with a primary trigger).  ``candidates``: symbol and the facts of step 1; ``events``: the result of ``binary_events``."""
    best = Z.best(zones).drop("spot", "reasons")
    df = R.screened(candidates).join(best, "symbol", "left").join(classes, "symbol", "left").join(events.drop(*[c for c in events.columns if c in candidates.columns and c != "symbol"]), "symbol", "left")
    df = df.withColumns({"in_step1": F.col("passed"), "currency": O.currency_of(F.col("country"))})
    df = df.withColumn("in_step2", F.col("in_step1") & F.col("center").isNotNull())
    return df.withColumn("in_step3", F.col("in_step2") & F.col("primary_trigger").isNotNull())


def funnel(rows: DataFrame) -> DataFrame:
    """One row: how many of ``selected`` each step leaves, and how many of the last have events near."""
    last = F.col("in_step3")
    return rows.agg(
        F.count("*").alias("universe"), F.count_if("in_step1").alias("step1"), F.count_if("in_step2").alias("step2"), F.count_if(last).alias("classified"),
        F.count_if(last).alias("final"), F.count_if(last & F.coalesce("has_events", F.lit(False))).alias("flagged"),
    )


def report_rows(rows: DataFrame) -> DataFrame:
    """CSV_COLUMNS of those of ``selected`` that pass all steps, in report order; columns that the input lacks are null."""
    df = rows.filter("in_step3")
    made = K.strikes(*[F.col(c) for c in ("lower", "upper", "center", "spot", "atr")], F.col("currency"))
    own = {
        "ticker": "symbol", "exchange": "exchange", "market_cap": "market_cap", "sector": "sector", "country": "country", "composite_label": "label", "justificacion_tipo": "label",
        "spot": "spot", "zona_min": "lower", "zona_max": "upper", "zona_centro": "center", "distancia_pct": "distance", "n_elementos": "n_elements", "confirmador_dinamico": "dynamic",
        "rsi_diario": "rsi_daily", "rsi_semanal": "rsi_weekly", "macd_estado": "macd_state", "momentum_score": "momentum_score", "sma50w_sobre_sma200w": "weeks_rising",
        "hv_percentile_52w": "hv_percentile", "price_target_consensus": "target", "price_target_upside_pct": "upside", "recommendation_mean": "recommendation_mean",
        "recommendation_buy_ratio": "buy_ratio", "downgrades_6w": "downgrades", "earnings_date": "earnings_date", "dias_a_earnings": "days_to_earnings", "earnings_en_45d": "earnings_near",
        "ex_div_date": "ex_div_date", "dias_a_ex_div": "days_to_ex_div", "ex_div_en_45d": "ex_div_near", "ex_div_amount": "ex_div_amount", "eventos_macro_en_45d": "macro_near",
        "eventos_macro_count": "macro_count", "tiene_eventos_binarios": "has_events", "flags_legibles": "flags", "fetched_at": "fetched_at", "regime": "regime",
        "primary_trigger": "primary_trigger", "triggers": "triggers",
    }
    columns = {name: F.col(c) if c in df.columns else F.lit(None).cast("string") for name, c in own.items()}
    columns |= {
        "score_soporte": fixed(F.col("score"), 1), "elementos_score": F.array_join(F.transform("elements", O.element_label), " | "), "wheel_candidate": F.lit(0),
        "momentum_signals": F.array_join("signals", "|"), "universes": F.array_join("universes", "|") if "universes" in df.columns else F.lit(""), **made,
    }
    return O.ordered(df).select(*[columns[c].alias(c) for c in CSV_COLUMNS])

"""Step-1 rules: each gives a reason or null; a candidate passes when no rule has one.  All rules are always evaluated."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluence import config as C
from confluence.functions.text import fixed


def upside(target: Column, spot: Column) -> Column:
    """Target over spot, less one; 0 without either."""
    return F.coalesce(F.when((target != 0) & (spot > 0), target / spot - 1), F.lit(0.0))


def buy_ratio(counts: list[Column]) -> Column:
    """(strong buys + buys) over all recommendations; 0 without any.  ``counts``: strong buy, buy, hold, sell, strong sell."""
    filled = [F.coalesce(c, F.lit(0)) for c in counts]
    return F.coalesce(F.try_divide(filled[0] + filled[1], sum(filled[1:], filled[0])).cast("double"), F.lit(0.0))


def momentum_score() -> Column:
    """0 to 3: a daily and a weekly RSI under 50 that rises, and a rising MACD state."""
    rising = lambda now, past: ((F.col(now) < C.RSI_MOMENTUM) & (F.col(now) > F.col(past))).cast("int")
    parts = [rising("rsi_daily", "rsi_daily_3_ago"), rising("rsi_weekly", "rsi_weekly_2_ago"), F.col("macd_state").startswith("subiendo").cast("int")]
    return sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0))


def _said(digits: int, column: str) -> Column:
    """A value in a reason; None for nulls."""
    return F.when(F.col(column).isNull(), F.lit("None")).otherwise(fixed(F.col(column), digits))


def _reason(head: str, value: Column, tail: str) -> Column:
    return F.concat(F.lit(head), value, F.lit(tail))


def quality() -> Column:
    """Size, liquidity and cash flow; the first that fails names the reason, nulls fail."""
    few = lambda c, least: F.col(c).isNull() | (F.col(c) < least)
    exempt = F.coalesce(F.col("sector").isin(*C.EXEMPT_SECTORS), F.lit(False))
    cash = F.col("free_cash_flow").isNull() | (F.col("free_cash_flow") <= C.MIN_CASH_FLOW)
    return (
        F.when(few("market_cap", C.MIN_MARKET_CAP), _reason("market cap (", _said(1, "market_cap"), f") < {C.MIN_MARKET_CAP:.0f}"))
        .when(few("avg_volume", C.MIN_VOLUME), _reason("avg daily volume (", _said(1, "avg_volume"), f") < {C.MIN_VOLUME:.0f}"))
        .when(~exempt & cash, _reason("FCF TTM (", _said(1, "free_cash_flow"), f") ≤ {C.MIN_CASH_FLOW}"))
    )


def valuation() -> Column:
    """Upside, opinions, and rating cuts where those are known: of countries not in ``UNRATED_COUNTRIES``, null included."""
    known = ~F.coalesce(F.col("country").isin(*C.UNRATED_COUNTRIES), F.lit(False))
    cuts = F.coalesce("downgrades", F.lit(0))
    return (
        F.when(~F.coalesce(F.col("upside") > C.MIN_UPSIDE, F.lit(False)), _reason("price target upside (", F.when(F.col("upside").isNull(), "None").otherwise(F.concat(fixed(F.col("upside") * 100, 1), F.lit("%"))), f") ≤ {C.MIN_UPSIDE:.1%}"))
        .when(~F.coalesce(F.col("buy_ratio") >= C.MIN_BUY_RATIO, F.lit(False)), _reason("buy ratio (", _said(2, "buy_ratio"), f") < {C.MIN_BUY_RATIO}"))
        .when(known & (cuts > C.MAX_DOWNGRADES), _reason("", cuts.cast("string"), f" downgrades en 6w > {C.MAX_DOWNGRADES}"))
    )


def momentum() -> Column:
    say = lambda name, c: _reason(f"{name} sobrecomprado (", _said(1, c), f" ≥ {C.OVERBOUGHT})")
    return F.when(F.col("rsi_daily") >= C.OVERBOUGHT, say("RSI_d", "rsi_daily")).when(F.col("rsi_weekly") >= C.OVERBOUGHT, say("RSI_w", "rsi_weekly"))


def volatility() -> Column:
    """Volatility's percentile within its band; a null one is below it."""
    high = F.coalesce(F.col("hv_percentile") > C.HV_HIGH, F.lit(False))
    low = ~F.coalesce(F.col("hv_percentile") >= C.HV_LOW, F.lit(False))
    return F.when(high, _reason("HV percentile ", _said(1, "hv_percentile"), f" > {C.HV_HIGH}")).when(low, _reason("HV percentile ", _said(1, "hv_percentile"), f" < {C.HV_LOW}"))


RULES: dict[str, Callable[[], Column]] = {"quality_liquidity": quality, "valuation": valuation, "momentum": momentum, "hv_percentile": volatility}


def register_filter(name: str, rule: Callable[[], Column]) -> None:
    """Adds a rule to ``screened``."""
    RULES[name] = rule


def screened(candidates: DataFrame) -> DataFrame:
    """Adds ``reasons`` ("name: reason" of every failing rule) and ``passed``."""
    found = F.array_compact(F.array(*[F.concat(F.lit(f"{n}: "), rule()) for n, rule in RULES.items()]))
    return candidates.withColumn("reasons", found).withColumn("passed", F.size("reasons") == 0)


def state_predicate(regimes=(), triggers=(), sectors=(), score_min: float = 0.0, earnings: bool | None = None, ex_div: bool | None = None, macro: bool | None = None, wheel_only: bool = False) -> Column:
    """The read side's filter over regime, primary_trigger, sector, score, earnings_near, ex_div_near, macro_near, wheel.

    Criteria that are empty, None, zero or False don't filter.  A null regime, trigger, sector or score is in no set and over
    no least score; flags must be as asked, and a null one is neither.
    """
    among = [F.coalesce(F.col(c), F.lit("")).isin(*some) for c, some in (("regime", regimes), ("primary_trigger", triggers), ("sector", sectors)) if some]
    flags = [F.coalesce(F.col(c) == wanted, F.lit(False)) for c, wanted in (("earnings_near", earnings), ("ex_div_near", ex_div), ("macro_near", macro)) if wanted is not None]
    score = [F.coalesce(F.col("score") >= score_min, F.lit(False))] if score_min > 0 else []
    wheel = [F.coalesce(F.col("wheel"), F.lit(False))] if wheel_only else []
    return reduce(Column.__and__, among + score + flags + wheel, F.lit(True))


def sectors(rows: DataFrame) -> DataFrame:
    """The sectors that occur, sorted; nulls and empty ones aren't any."""
    return rows.select("sector").filter("sector <> ''").distinct().orderBy("sector")

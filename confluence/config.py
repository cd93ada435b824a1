"""Thresholds and lookup tables of the screening rules: fixed values, in natural order."""

from __future__ import annotations

# bars and indicators
MIN_BARS, REFRESH_BARS = 252, 7
RSI_LENGTH, ATR_LENGTH = 14, 14
MACD_FAST, MACD_SLOW, MACD_SIGNAL, MACD_LOOKBACK, MACD_NEUTRAL, EPSILON = 12, 26, 9, 3, 0.05, 1e-9
HV_LENGTH, HV_WINDOW, DAYS_PER_YEAR = 20, 252, 252

# step 1
MIN_MARKET_CAP, MIN_VOLUME, MIN_CASH_FLOW = 10e9, 1e6, 0.0
EXEMPT_SECTORS = ("Utilities", "Financial Services", "Real Estate")
#: Countries, by name and by code, whose rating changes aren't known.
UNRATED_COUNTRIES = (
    "Austria", "Belgium", "Bermuda", "Denmark", "Finland", "France", "Germany", "Ireland", "Italy", "Luxembourg", "Netherlands", "Norway", "Portugal", "Spain",
    "Sweden", "Switzerland", "United Kingdom",
    "AT", "BE", "BM", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PT", "SE",
)
MIN_UPSIDE, MIN_BUY_RATIO, MAX_DOWNGRADES, DOWNGRADE_WEEKS = 0.0, 0.45, 1, 6
OVERBOUGHT, RSI_MOMENTUM, RSI_DAILY_LOOKBACK, RSI_WEEKLY_LOOKBACK = 70.0, 50.0, 3, 2
HV_LOW, HV_HIGH = 30.0, 90.0

# pivots, levels and zones
PIVOT_REACH, PIVOT_FALLBACK, PIVOT_DEPTH = 5, 20, 1.0
LEVEL_WINDOW, DIVERGENCE_BARS = 252, 60
FIBONACCI = (("fib_618", 0.618), ("fib_786", 0.786))
HVN_BUCKETS, HVN_PERCENTILE = 50, 0.8
CLUSTER_ATR, CLUSTER_SPOT, CLUSTER_WIDTH, CLUSTER_BUFFER = 0.4, 0.01, 0.04, 0.001
MAX_DISTANCE, MIN_DISTANCE, HEAVY_WEIGHT, MIN_HEAVY, MIN_SCORE = 0.10, 0.03, 2.5, 2, 5.0
DENSITY_FLOOR, DENSITY_REFERENCE, DENSITY_SLOPE, DENSITY_LOW, DENSITY_HIGH = 0.005, 100.0, 0.005, 0.85, 1.5
TIERS = ((18.0, 5), (13.0, 4), (9.0, 3), (6.5, 2), (5.0, 1))
WEIGHTS = {
    "sma_200d": 3.0, "sma_200w": 3.0, "polarity": 3.0, "ema_200d": 2.5, "sma_50d": 2.5, "avwap_pivot_low": 2.5, "avwap_earnings": 2.5,
    "avwap_52w_high": 2.0, "sma_50w": 2.0, "hvn": 2.0, "ema_50d": 1.5, "fib_618": 1.5, "gap_unfilled": 1.0, "fib_786": 0.0, "divergence": 0.0,
}
CONFIRMERS = ("avwap", "hvn", "divergence")

# patterns
DOUBLE_BOTTOM_BARS, DOUBLE_BOTTOM_GAP, DOUBLE_BOTTOM_TOLERANCE, DOUBLE_BOTTOM_BOUNCE = 180, (15, 80), 0.03, 0.08
CAPITULATION_BARS, CAPITULATION_RANGE, CAPITULATION_VOLUME, CAPITULATION_CLOSE = 60, 2.5, 2.5, 0.66
CAPITULATION_DROP_BARS, CAPITULATION_DROP, RECLAIM_BARS = 10, -0.08, 10
HMA_WEEKS, HMA_RECENT, HMA_SLOPE, HMA_MIN_WEEKS = 50, 3, 0.001, 100

# regimes and triggers
REGIME_TOLERANCE, REGIME_BARS, REGIME_RANGE = 0.03, 60, 0.15
RANGE_FLOOR_BARS, RANGE_FLOOR = 60, 0.33
DIP_DAYS, DIP, DIP_BARS = 60, -0.05, 2
DIVERGENCE_DAYS, DIVERGENCE_RSI = 60, 45.0
#: Triggers in the order in which they are evaluated: weight, regimes.
TRIGGERS = (
    ("pullback_in_uptrend", 0.7, ("uptrend",)),
    ("double_bottom_confirmed", 1.0, ("downtrend", "reversal")),
    ("double_bottom_unconfirmed", 0.5, ("downtrend", "reversal")),
    ("capitulation_reclaim", 0.9, ("downtrend", "reversal")),
    ("hma_weekly_flip", 0.5, ("reversal",)),
    ("range_floor", 0.6, ("lateral",)),
    ("post_earnings_dip", 0.6, ("uptrend", "lateral", "reversal")),
    ("bullish_divergence", 0.0, ("uptrend", "downtrend", "lateral", "reversal")),
)

# the first generation of types
T2_DROP, T2_MIN_BARS = -0.10, 6
T3_TOLERANCE, T3_BARS, T3_COMPACT, T3_FLOOR = 0.03, 60, 0.15, 0.3
T4_DAYS, T4_DROP, T4_TREND, T4_RSI = 60, -0.05, 0.97, 55.0

# events, strikes, reports
EVENT_DAYS = 45
GRIDS = {
    "USD": ((25, 0.5), (100, 1.0), (250, 2.5), (None, 5.0)),
    "EUR": ((25, 0.5), (100, 1.0), (250, 2.5), (None, 5.0)),
    "CHF": ((25, 0.5), (100, 1.0), (250, 2.5), (None, 5.0)),
    "GBP": ((25, 0.5), (100, 1.0), (250, 2.5), (None, 5.0)),
    "GBp": ((2500, 50.0), (10000, 100.0), (25000, 250.0), (None, 500.0)),
}
STRIKE_ATR = 1.0
REPORT_ORDER = (("T1", 1), ("T2", 2), ("T4", 3), ("T3", 4), ("T5", 5))
REPORT_LAST = 99

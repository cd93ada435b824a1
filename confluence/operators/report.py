"""Report columns: prices, labels, narratives, chart points, and the CSV sink."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confluence import config as C
from confluence.functions.text import fixed

# How a currency's prices are written, currencies by country, and labels.
CURRENCIES = {
    "CHF": ("", " CHF"), "DKK": ("", " kr"), "EUR": ("€", ""), "GBP": ("£", ""), "GBp": ("", "p"), "JPY": ("¥", ""), "NOK": ("", " kr"), "SEK": ("", " kr"), "USD": ("$", ""),
}
COUNTRY_CURRENCY = {
    "Austria": "EUR", "Belgium": "EUR", "Denmark": "DKK", "Finland": "EUR", "France": "EUR", "Germany": "EUR", "Ireland": "EUR", "Italy": "EUR", "Netherlands": "EUR",
    "Norway": "NOK", "Portugal": "EUR", "Spain": "EUR", "Sweden": "SEK", "Switzerland": "CHF", "United Kingdom": "GBp", "United States": "USD",
}
TIER_LABELS = {1: "Mínimo viable", 2: "Borderline", 3: "Sólida", 4: "Fuerte", 5: "Confluencia excepcional"}
ELEMENT_LABELS = {
    "avwap_52w_high": "AVWAP_52w_high", "avwap_earnings": "AVWAP_earnings", "avwap_pivot_low": "AVWAP_pivot_low", "divergence": "DIVERGENCIA", "ema_200d": "EMA200D",
    "ema_50d": "EMA50D", "fib_618": "FIB_618", "fib_786": "FIB_786", "gap_unfilled": "GAP", "hvn": "HVN", "polarity": "POLARIDAD", "sma_200d": "SMA200D",
    "sma_200w": "SMA200W", "sma_50d": "SMA50D", "sma_50w": "SMA50W",
}
MONTHS = ("ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic")
CHART_TITLE, ZONE_COLOR, STRIKE_COLORS = "Precio últimos 6 meses con zona de soporte y strikes sugeridos", "#fbbf24", ("#dc2626", "#f97316", "#16a34a")
WIDTH, HEIGHT, PAD_X, PAD_Y, POINTS, LEAST_POINTS, EXTRA = 480, 200, 28, 10, 126, 30, 0.05


def format_price(value: Column, currency: Column) -> Column:
    """A price with two digits and its currency's sign; dollars for unknown ones."""
    text = fixed(value, 2)
    out = F.concat(F.lit("$"), text)
    for name, (before, after) in CURRENCIES.items():
        out = F.when(currency == name, F.concat(F.lit(before), text, F.lit(after))).otherwise(out)
    return F.when(value.isNotNull(), out)


def currency_of(country: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in COUNTRY_CURRENCY.items() for x in pair]), country), F.lit("USD"))


def short_number(value: Column) -> Column:
    """1.2B, 3.4M, 5.6K."""
    say = lambda size, mark: F.concat(fixed(value / size, 1), F.lit(mark))
    return F.when(value >= 1e9, say(1e9, "B")).when(value >= 1e6, say(1e6, "M")).when(value >= 1e3, say(1e3, "K")).otherwise(fixed(value, 0))


def stars(tier: Column) -> Column:
    return F.repeat(F.lit("⭐"), tier)


def tier_label(tier: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in TIER_LABELS.items() for x in pair]), tier)


def element_label(element: Column) -> Column:
    """A level's label; unknown ones in upper case."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in ELEMENT_LABELS.items() for x in pair]), element), F.upper(element))


def day_label(date: Column) -> Column:
    """``12 mar``."""
    return F.concat_ws(" ", F.dayofmonth(date).cast("string"), F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(date)))


def by_weight(held: Column) -> Column:
    """A zone's elements (structs with ``element``), heaviest first, ties in their order."""
    from confluence.operators.zones import weight

    placed = F.transform(held, lambda e, i: F.struct((-weight(e["element"])).alias("minus"), i.alias("at"), e.alias("held")))
    return F.transform(F.array_sort(placed), lambda p: p["held"])


def priority(kind: Column) -> Column:
    return reduce(lambda out, p: F.when(kind == p[0], p[1]).otherwise(out), C.REPORT_ORDER, F.lit(C.REPORT_LAST))


def ordered(rows: DataFrame) -> DataFrame:
    """By type, then score and nearness; symbols break ties."""
    return rows.orderBy(priority(F.col("legacy")), F.desc("score"), "distance", "symbol")


def width_word(width: Column) -> Column:
    return F.when(width < 0.02, "compacta").when(width < 0.035, "ajustada").otherwise("amplia")


def chart_points(bars: DataFrame) -> DataFrame:
    """symbol, pos, x, y: the last closes scaled to the chart; none for short or flat series."""
    whole, newest = W.partitionBy("symbol"), W.partitionBy("symbol").orderBy(F.desc("date"))
    df = bars.withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= POINTS)
    df = df.withColumns({"_n": F.count("*").over(whole), "_lo": F.min("close").over(whole), "_hi": F.max("close").over(whole), "pos": F.row_number().over(W.partitionBy("symbol").orderBy("date")) - 1})
    df = df.filter((F.col("_n") >= LEAST_POINTS) & (F.col("_hi") > F.col("_lo")))
    low, high = F.col("_lo") - EXTRA * (F.col("_hi") - F.col("_lo")), F.col("_hi") + EXTRA * (F.col("_hi") - F.col("_lo"))
    x = PAD_X + F.col("pos") * (WIDTH - 2.0 * PAD_X) / (F.col("_n") - 1)
    y = HEIGHT - PAD_Y - (F.col("close") - low) / (high - low) * (HEIGHT - 2.0 * PAD_Y)
    return df.select("symbol", "pos", x.alias("x"), y.alias("y"))


def chart(bars: DataFrame, rows: DataFrame) -> DataFrame:
    """symbol, svg: the last closes with the zone's band, strikes and labels; empty for series that are short or flat.

    ``rows``: symbol, lower, upper, currency and the three strikes.  A chart has at most POINTS closes.
    """
    newest = W.partitionBy("symbol").orderBy(F.desc("date"))
    cut = bars.select("symbol", "date", "close").withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= POINTS)
    held = cut.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("date", "close"))).alias("held"))
    closes = F.transform("held", lambda p: p["close"])
    strikes = ("strike_aggressive", "strike_natural", "strike_conservative")
    every = F.concat(closes, F.array("lower", "upper", *strikes))
    df = held.join(rows.select("symbol", "lower", "upper", "currency", *strikes), "symbol").withColumns({"n": F.size("held"), "least": F.array_min(every), "most": F.array_max(every)})
    span = F.col("most") - F.col("least")
    bottom, height = F.col("least") - EXTRA * span, span * (1 + 2 * EXTRA)
    wide, high = WIDTH - 2.0 * PAD_X, HEIGHT - 2.0 * PAD_Y
    one = lambda c: fixed(c, 1)
    x = lambda i: PAD_X + i * F.lit(wide) / (F.col("n") - 1)
    y = lambda p: PAD_Y + (1 - (p - bottom) / height) * high
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    points = F.array_join(F.transform("held", lambda p, i: text(one(x(i)), ",", one(y(p["close"])))), " ")
    line = lambda c, color: text(f'<line x1="{PAD_X:.1f}" x2="{PAD_X + wide:.1f}" y1="', one(y(F.col(c))), '" y2="', one(y(F.col(c))), f'" stroke="{color}" stroke-width="1.2" stroke-dasharray="3 3"/>')
    label = lambda where, shade, *what: text(f'<text {where} font-size="8" fill="currentColor" opacity="{shade}"', *what, "</text>")
    parts = [
        F.lit(f'<svg viewBox="0 0 {WIDTH} {HEIGHT}" xmlns="http://www.w3.org/2000/svg" role="img" aria-label="{CHART_TITLE}">'),
        text(f'<rect x="{PAD_X:.1f}" y="', one(y(F.col("upper"))), f'" width="{wide:.1f}" height="', one(y(F.col("lower")) - y(F.col("upper"))), f'" fill="{ZONE_COLOR}" fill-opacity="0.18"/>'),
        *[line(c, color) for c, color in zip(strikes, STRIKE_COLORS)],
        text('<polyline points="', points, '" fill="none" stroke="currentColor" stroke-width="1.4" opacity="0.85"/>'),
        text(f'<circle cx="{PAD_X + wide:.1f}" cy="', one(y(F.element_at(closes, -1))), '" r="3.5" fill="currentColor"/>'),
        label(f'x="2" y="{PAD_Y + 8:.1f}"', 0.55, ">", format_price(F.col("most"), F.col("currency"))),
        label(f'x="2" y="{HEIGHT - PAD_Y:.1f}"', 0.55, ">", format_price(F.col("least"), F.col("currency"))),
        label(f'x="{PAD_X:.1f}" y="{HEIGHT - 1:.1f}"', 0.45, ">", day_label(F.element_at("held", 1)["date"])),
        label(f'x="{PAD_X + wide:.1f}" y="{HEIGHT - 1:.1f}"', 0.45, ' text-anchor="end">hoy'),
        F.lit("</svg>"),
    ]
    return df.select("symbol", F.when((F.col("n") >= LEAST_POINTS) & (span > 0), F.concat_ws("\n", *parts)).otherwise("").alias("svg"))


def write_csv(rows: DataFrame, folder: str, date: str, hhmm: str) -> tuple[str, str]:
    """CSV folders ``screening_<date>_<hhmm>`` and ``screening_latest`` with a header: nulls empty, lists joined by `` | ``.
    For a report's few rows."""
    flat = [F.array_join(c, " | ").alias(c) if t.startswith("array") else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c, t in rows.dtypes]
    paths = f"{folder}/screening_{date}_{hhmm}", f"{folder}/screening_latest"
    for path in paths:
        rows.select(*flat).coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
    return paths

"""A candidate's story in three paragraphs of HTML: its situation, its zone, and what to watch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from confluence import config as C
from confluence.functions import strikes as K
from confluence.functions.text import fixed
from confluence.operators.report import format_price, width_word
from confluence.operators.zones import category, weight

# The wording of a report.
TYPES = {
    "T1": "tendencia alcista intacta con pullback a soporte", "T2": "pánico de mercado o spike de IV", "T3": "lateralización en zona técnica",
    "T4": "post-earnings dip con tendencia intacta", "T5": "wheel / acumulación",
}
OTHER_TYPE = "situación técnica"
PHRASES = {
    "polarity": "una resistencia rota previamente que ahora opera como soporte", "sma_200": "la SMA200 como referencia institucional de largo plazo",
    "sma_50": "la SMA50 como soporte de mediano plazo",
}
ANCHORS = {"avwap_52w_high": "el máximo de 52 semanas", "avwap_earnings": "earnings", "avwap_pivot_low": "el último pivot bajo"}
AVWAP = ("el AVWAP desde ", " como precio promedio de acumulación reciente")
NEAR, NEAR_WORDS, FAR_WORDS = 0.08, "dentro del rango operable", "al límite del rango operable"
EARNINGS = " días — considerar dimensionar la posición para evento o evitar strikes que asignen alrededor del reporte."
EX_DIV = " — riesgo de asignación temprana del put si la opción queda ITM en esa fecha."
CALM = "Sin eventos binarios ni macro en ventana — situación técnica limpia."


def _of(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _paragraph(*sentences: Column) -> Column:
    """Sentences that aren't null, one blank between them."""
    return _text("<p>", F.concat_ws(" ", *sentences), "</p>")


def heavy_phrases(elements: Column) -> Column:
    """A phrase for each category of the heavy elements, in order of appearance; the first of a category speaks for it."""
    heavy = F.filter(elements, lambda e: weight(e) >= C.HEAVY_WEIGHT)
    own = F.transform(heavy, lambda e: F.struct(category(e).alias("category"), e.alias("element")))
    first = F.filter(own, lambda x, i: F.array_position(F.transform(own, lambda y: y["category"]), x["category"]) == i + 1)
    said = lambda x: F.when(x["category"] == "avwap", _text(AVWAP[0], _of(ANCHORS, x["element"]), AVWAP[1])).otherwise(_of(PHRASES, x["category"]))
    return F.array_compact(F.transform(first, said))


def situation() -> Column:
    """Null without a type."""
    whole = lambda c: fixed(c, 0)
    rsi, past = F.col("rsi_daily"), F.col("rsi_daily_3_ago")
    lead = _text("<strong>Situación.</strong> ", F.col("symbol"), " está en un contexto <strong>", F.col("legacy"), "</strong> (", F.coalesce(_of(TYPES, F.col("legacy")), F.lit(OTHER_TYPE)), ").")
    return F.when(
        F.col("legacy").isNotNull(),
        _paragraph(
            lead, F.when((rsi < C.RSI_MOMENTUM) & (rsi > past), _text("RSI diario en ", whole(rsi), " con giro al alza desde ", whole(past), ".")),
            F.when(F.col("macd_state").startswith("subiendo"), F.lit("MACD virando a positivo.")),
            F.when(rsi >= C.OVERBOUGHT, _text("Atención: RSI diario en zona de sobrecompra (", whole(rsi), ").")),
        ),
    )


def zone() -> Column:
    percent = lambda c: fixed(F.col(c) * 100, 1)
    phrases = heavy_phrases(F.col("elements"))
    anchored = F.when(F.size(phrases) == 1, _text("Anclada en ", F.get(phrases, F.lit(0)), ".")).when(
        F.size(phrases) > 1, _text("Anclada en ", F.size(phrases).cast("string"), " elementos heavy: ", F.array_join(phrases, "; "), ".")
    )
    price = lambda c: format_price(F.col(c), F.col("currency"))
    return _paragraph(
        _text("<strong>Zona.</strong> La zona detectada está en ", price("lower"), " – ", price("upper"), " (ancho ", percent("width_pct"), "%, ", width_word(F.col("width_pct")), ")."),
        anchored,
        _text("El precio está a ", percent("distance"), "% del techo de la zona, ", F.when(F.col("distance") < NEAR, NEAR_WORDS).otherwise(FAR_WORDS), "."),
    )


def watch() -> Column:
    made = K.strikes(*[F.col(c) for c in ("lower", "upper", "center", "spot", "atr")], F.col("currency"))
    earnings = F.when(F.col("earnings_near"), _text("Earnings en ", F.col("days_to_earnings").cast("string"), EARNINGS))
    amount = F.coalesce(_text(" ($", fixed(F.col("ex_div_amount"), 2), ")"), F.lit(""))
    amount = F.when(F.col("ex_div_amount").isNull(), "").otherwise(amount)
    dividend = F.when(F.col("ex_div_near"), _text("Ex-dividend en ", F.col("days_to_ex_div").cast("string"), " días", amount, EX_DIV))
    macro = F.when(F.col("macro_near"), _text("Eventos macro en ventana: ", F.col("macro_kinds"), "."))
    calm = F.when(F.coalesce(earnings, dividend, macro).isNull(), F.lit(CALM))
    broken = _text("Si el precio cierra debajo del conservative (", format_price(made["strike_conservative"], F.col("currency")), "), conviene revisar la tesis.")
    return _paragraph(F.lit("<strong>Qué mirar.</strong>"), broken, earnings, dividend, macro, calm)


def narrative() -> Column:
    """Paragraphs that aren't null, one a line; empty without a zone.

    Columns: symbol, legacy, rsi_daily, rsi_daily_3_ago, macd_state, elements, lower, upper, center, width_pct, distance, spot, atr, currency,
    and those of ``binary_events``.
    """
    return F.when(F.col("center").isNull(), "").otherwise(F.concat_ws("\n", situation(), zone(), watch()))

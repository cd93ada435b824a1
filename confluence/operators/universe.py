"""Universes of symbols: tags, symbol forms, watchlists and table cells of web pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluence.operators import html_tables as H

# Exchange suffixes by country and by the two-letter market code behind a symbol, and the quote site's countries.
COUNTRY_SUFFIX = {
    "Austria": ".VI", "Belgium": ".BR", "Bermuda": ".L", "Denmark": ".CO", "Finland": ".HE", "France": ".PA", "Germany": ".DE", "Ireland": ".L", "Italy": ".MI",
    "Luxembourg": ".AS", "Netherlands": ".AS", "Norway": ".OL", "Portugal": ".LS", "Spain": ".MC", "Sweden": ".ST", "Switzerland": ".SW", "United Kingdom": ".L",
}
MARKET_SUFFIX = {
    "AV": ".VI", "BB": ".BR", "DC": ".CO", "FH": ".HE", "FP": ".PA", "GR": ".DE", "IM": ".MI", "LN": ".L", "NA": ".AS", "NO": ".OL", "PL": ".LS", "SM": ".MC", "SS": ".ST",
    "SW": ".SW",
}
QUOTE_COUNTRY = {
    ".AS": "nl", ".BR": "be", ".CO": "dk", ".DE": "de", ".HE": "fi", ".L": "uk", ".LS": "pt", ".MC": "es", ".MI": "it", ".OL": "no", ".PA": "fr", ".ST": "se", ".SW": "ch",
    ".VI": "at",
}


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def dashed(symbol: Column) -> Column:
    """``BRK.B`` as ``BRK-B``."""
    return F.replace(F.upper(F.trim(symbol)), F.lit("."), F.lit("-"))


def by_country(symbol: Column, country: Column) -> Column:
    """A symbol with its country's exchange suffix, blanks as dashes; null where the country has none."""
    return F.concat(F.replace(F.upper(F.trim(symbol)), F.lit(" "), F.lit("-")), F.try_element_at(_map(COUNTRY_SUFFIX), country))


def by_market(symbol: Column) -> Column:
    """``VOD LN`` as ``VOD.L``, and ``asml.as``, which has its suffix, as ``ASML.AS``; null for others and for unknown markets."""
    text = F.upper(F.trim(symbol))
    market = F.try_element_at(_map(MARKET_SUFFIX), F.substring_index(text, " ", -1))
    base = F.trim(F.regexp_replace(text, " [^ ]*$", ""))
    known = F.concat(F.lit("."), F.substring_index(text, ".", -1)).isin(*QUOTE_COUNTRY) & ~text.startswith(".")
    return F.when(F.instr(text, " ") > 0, F.when(base != "", F.concat(base, market))).when((F.instr(text, ".") > 0) & known, text)


def is_domestic(symbol: Column) -> Column:
    """Whether a symbol ends in none of the known foreign suffixes."""
    return ~reduce(Column.__or__, [symbol.endswith(s) for s in QUOTE_COUNTRY])


def quoted(symbol: Column) -> Column:
    """``AAPL`` as ``aapl.us``, ``VOD.L`` as ``vod.uk``; null for unknown suffixes."""
    country = F.try_element_at(_map(QUOTE_COUNTRY), F.concat(F.lit("."), F.substring_index(symbol, ".", -1)))
    base = F.lower(F.regexp_replace(symbol, r"\.[^.]*$", ""))
    return F.when(F.instr(symbol, ".") == 0, F.concat(F.lower(symbol), F.lit(".us"))).otherwise(F.concat(base, F.lit("."), country))


def watchlist(lines: DataFrame, line: str = "value") -> DataFrame:
    """symbol, valid of each line that is neither blank nor a ``#`` comment; comments behind a symbol are cut."""
    text = F.upper(F.trim(F.substring_index(F.col(line), "#", 1)))
    return lines.select(text.alias("symbol")).filter("symbol <> ''").select("symbol", F.col("symbol").rlike(r"^[\p{L}\p{N}./-]+$").alias("valid"))


def tagged(universes: dict[str, DataFrame]) -> DataFrame:
    """symbol, universes: the sorted names of the universes that hold each symbol."""
    parts = [df.select("symbol", F.lit(name).alias("universe")) for name, df in universes.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("symbol").agg(F.array_sort(F.collect_set("universe")).alias("universes"))


def cells(pages: DataFrame, tag: str = "li", html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, pos, cell): the texts of an element's occurrences, tags inside removed, in order."""
    found = F.regexp_extract_all(F.col(html), F.lit(f"(?s)<{tag}[^>]*>(.*?)</{tag}>"), 1)
    return pages.select(key, F.posexplode(found).alias("pos", "raw")).select(key, "pos", F.trim(F.regexp_replace("raw", "<[^>]*>", "")).alias("cell"))


def table_column(pages: DataFrame, names: tuple[str, ...], html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, pos, value): a column of each page's first table whose header row has one of ``names`` and whose column holds
    any text; empty cells and short rows are left out.  Pages without such a table have no rows."""
    return H.columns(pages, {"value": names}, html, key)


def constituents(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, pos, ticker, country, symbol) of each page's first table with the headers ``Ticker`` and ``Country``; symbol has
    the country's exchange suffix, and is null for countries without one."""
    rows = H.columns(pages, {"ticker": ("Ticker",), "country": ("Country",)}, html, key, head=("th",), body=("td",), first=True)
    return rows.withColumn("symbol", by_country(F.col("ticker"), F.col("country")))


def chosen(text: str, known: tuple[str, ...]) -> list[str]:
    """The universes that a comma-separated argument names; an unknown or missing one raises ValueError."""
    names = [n.strip().lower() for n in text.split(",") if n.strip()]
    if not names or (odd := [n for n in names if n not in known]):
        raise ValueError(f"unknown universes: {odd if names else text!r}; known: {', '.join(known)}")
    return names


def first_symbols(symbols: DataFrame, n: int) -> DataFrame:
    """The first n symbols in alphabetical order."""
    return symbols.orderBy("symbol").limit(n)

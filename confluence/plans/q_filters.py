"""Queries over candidates, step-1 rules, events and universes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confluence import config as C
from confluence.functions import series as S
from confluence.operators import events as E
from confluence.operators import filters as R
from confluence.operators import universe as U
from confluence.plans.catalog import query
from confluence.plans.q_levels import inputs
from confluence.plans.q_series import HV_SQL, MACD_SQL, RSI_SQL, WITH, r6
from confluence.sources import federation as S2
from confluence.sources import projections as J
from confluence.sources import tape
from confluence.sources.calendar_yaml import macro_yaml, write_yaml
from confluence.sources.scratch import once

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
COUNTS = ("strong_buy", "buy", "hold", "sell", "strong_sell")
# Countries of the derived universe by a symbol's first letter; M has none.
COUNTRIES = {"E": "United States", "L": "Canada", "P": "Germany", "S": "FR"}
# Kinds of releases by the day of the month.
KINDS = ("fomc", "cpi", "ppi", "nfp", "gdp", "other")
LATER = 120
MACRO_SQL = f"""macro as (select date, ({list(KINDS)})[day(date) % 6 + 1] as kind, 'orders: ' || n || ' "firm" # of the day' as description
  from (select cast(o_orderdate as date) + {LATER} as date, count(*) as n from orders group by 1))"""


def macro(spark, sf_dir):
    """A calendar in which each day of orders is followed by a release; written to YAML files once and read from them."""

    def make(path):
        days = tape.read(spark, sf_dir, "orders").groupBy(F.date_add(F.col("o_orderdate").cast("date"), LATER).alias("date")).agg(F.count("*").alias("n"))
        kind = F.element_at(F.lit(list(KINDS)), F.dayofmonth("date") % 6 + 1)
        write_yaml(days.select("date", kind.alias("kind"), F.format_string('orders: %d "firm" # of the day', "n").alias("description")), f"{path}/calendar")

    return macro_yaml(spark, once(spark, "macro_calendar", sf_dir, make) + "/calendar")


def fundamentals(spark, sf_dir):
    """symbol, market_cap, avg_volume, free_cash_flow, sector, country, and the five recommendation counts, from order tables.

    A priority is an opinion; of the two lowest only even orders count, so that some symbols are recommended.
    """
    part = tape.read(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("symbol"), "p_retailprice", "p_size")
    lines = tape.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount")
    orders = tape.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    size = part.groupBy("symbol").agg((F.sum(F.round(F.col("p_retailprice") * 100).cast("long")) * 100000.0).alias("market_cap"), F.max("p_size").alias("size"))
    sold = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    flow = sold.groupBy("symbol").agg((F.sum(F.col("l_quantity").cast("long")) * 100.0).alias("avg_volume"), F.sum(F.lit(5) - F.round(F.col("l_discount") * 100).cast("long")).cast("double").alias("free_cash_flow"))
    rated = sold.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("symbol").agg(*[F.count_if((F.col("o_orderpriority") == p) & ((F.col("o_orderkey") % 2 == 0) | (p < "4"))).alias(c) for p, c in zip(PRIORITIES, COUNTS)])
    sector = F.when(F.col("symbol") == "PROMO", "Utilities").otherwise("Technology")
    country = F.element_at(F.create_map(*[F.lit(x) for pair in COUNTRIES.items() for x in pair]), F.substring("symbol", 1, 1))
    return size.join(flow, "symbol").join(rated, "symbol").select("symbol", "market_cap", "avg_volume", "free_cash_flow", sector.alias("sector"), country.alias("country"), *COUNTS)


FUND_SQL = f"""sold as (select l.*, p.p_type as symbol from lineitem l join part p on l_partkey = p_partkey),
fund as (select s.symbol, market_cap, avg_volume, free_cash_flow, case when s.symbol = 'PROMO' then 'Utilities' else 'Technology' end as sector, case s.symbol[1] {' '.join(f"when '{k}' then '{v}'" for k, v in COUNTRIES.items())} end as country, {', '.join(COUNTS)}
  from (select p_type as symbol, sum(cast(round(p_retailprice * 100) as bigint)) * 100000.0::double as market_cap from part group by 1) s
  join (select symbol, sum(cast(l_quantity as bigint)) * 100.0::double as avg_volume, cast(sum(5 - cast(round(l_discount * 100) as bigint)) as double) as free_cash_flow from sold group by 1) f using (symbol)
  join (select symbol, {', '.join(f"count(*) filter (o_orderpriority = '{p}'{' and o_orderkey % 2 = 0' if p >= '4' else ''}) as {c}" for p, c in zip(PRIORITIES, COUNTS))} from sold join orders on l_orderkey = o_orderkey group by 1) r using (symbol))"""


@query(f"with {FUND_SQL} select * from fund")
def assemble_candidates(spark, sf_dir):
    return fundamentals(spark, sf_dir)


@query(f"with {FUND_SQL} select symbol, round((strong_buy + buy)::double / (strong_buy + buy + hold + sell + strong_sell), 6) as buy_ratio, round((1.0 * strong_buy + 2 * buy + 3 * hold + 4 * sell + 5 * strong_sell)::double / (strong_buy + buy + hold + sell + strong_sell), 6) as recommendation_mean from fund")
def buy_ratio(spark, sf_dir):
    df = fundamentals(spark, sf_dir)
    total = reduce(lambda a, b: a + b, [F.col(c) for c in COUNTS])
    mean = F.try_divide(reduce(lambda a, b: a + b, [F.col(c) * float(i + 1) for i, c in enumerate(COUNTS)]), total)
    return df.select("symbol", r6(R.buy_ratio([F.col(c) for c in COUNTS]), "buy_ratio"), r6(mean, "recommendation_mean"))


def ratings(spark, sf_dir):
    """symbol, date, action from the events table: a symbol for each user, an action for each type."""
    ev = tape.read(spark, sf_dir, "events")
    action = F.element_at(F.create_map(*[F.lit(x) for x in ("purchase", "upgrade", "error", "downgrade", "signup", "init", "click", "maintain")]), F.col("event_type"))
    symbol = F.concat(F.lit("U"), F.col("user_id").cast("string"))
    return ev.select(symbol.alias("symbol"), F.col("ts").cast("date").alias("date"), F.coalesce(action, "event_type").alias("action"))


@query("""with r as (select 'U' || cast(user_id as varchar) as symbol, cast(ts as date) as date, event_type from events), t as (select max(date) as today from r)
select symbol, count(*) filter (event_type = 'error' and date >= today - 42) as downgrades, max(date) filter (event_type = 'error') as last_downgrade from r, t group by symbol""")
def downgrades_6w(spark, sf_dir):
    r = ratings(spark, sf_dir)
    today = r.agg(F.max("date").alias("today"))  # one row
    down = F.col("action") == "downgrade"
    return r.crossJoin(F.broadcast(today)).groupBy("symbol").agg(F.count_if(down & (F.col("date") >= F.date_sub("today", 42))).alias("downgrades"), F.max(F.when(down, F.col("date"))).alias("last_downgrade"))


#: An event of this type and value counts as a rating cut of the symbol of the part that its user stands for.
CUT = "event_type = 'error' and value >= 200"
CUTS_SQL = f"""cuts as (select p.p_type as symbol, count(*) as downgrades from events e join part p on e.user_id = p.p_partkey
  where {CUT} and cast(ts as date) >= (select max(cast(ts as date)) from events) - 42 group by 1)"""


def symbol_cuts(spark, sf_dir):
    """symbol, downgrades: rating cuts of the last six weeks."""
    ev = tape.read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("date"), "event_type", "value")
    last = ev.agg(F.max("date").alias("last"))  # one row
    part = tape.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("user_id"), F.col("p_type").alias("symbol"))
    return ev.filter(CUT).crossJoin(F.broadcast(last)).filter(F.col("date") >= F.date_sub("last", 7 * C.DOWNGRADE_WEEKS)).join(part, "user_id").groupBy("symbol").agg(F.count("*").alias("downgrades"))


def series_facts(bars, weeks):
    """symbol, spot, macd_state, hv_percentile, and RSIs now and some bars ago, from bars with oscillators: two aggregates."""
    at = lambda c, ago: F.max(F.when(F.col("rn") == F.col("top") - ago, F.col(c)))
    now = F.max_by("hv", "rn").over(W.partitionBy("symbol"))
    share = 100.0 * F.count_if((F.col("rn") > F.col("top") - C.HV_WINDOW) & (F.round("hv", 9) <= F.round("_now", 9))) / C.HV_WINDOW
    day = S.with_hv(bars.select("symbol", "date", "rn", "top", "close", "rsi", "macd_state")).withColumn("_now", now).groupBy("symbol").agg(
        at("close", 0).alias("spot"), at("rsi", 0).alias("rsi_daily"), at("rsi", C.RSI_DAILY_LOOKBACK).alias("rsi_daily_3_ago"), at("macd_state", 0).alias("macd_state"),
        F.when(F.count("*") >= C.HV_WINDOW + C.HV_LENGTH, F.round(share, 6)).otherwise(50.0).alias("hv_percentile"),
    )
    own = S.with_rsi(weeks.select("symbol", "date", "rn", "close")).withColumn("top", F.max("rn").over(W.partitionBy("symbol")))
    return day.join(own.groupBy("symbol").agg(at("rsi", 0).alias("rsi_weekly"), at("rsi", C.RSI_WEEKLY_LOOKBACK).alias("rsi_weekly_2_ago")), "symbol")


def candidates(spark, sf_dir, today=None):
    """Fundamentals with rating cuts and, as of a day, series facts: one row per symbol."""
    df = fundamentals(spark, sf_dir).join(series_facts(*inputs(spark, sf_dir, today)[:2]), "symbol")
    df = df.join(symbol_cuts(spark, sf_dir), "symbol", "left").withColumn("downgrades", F.coalesce("downgrades", F.lit(0).cast("long")))
    total = reduce(lambda a, b: a + b, [F.col(c) for c in COUNTS])
    target = F.round(F.col("spot") * (1 + (F.col("strong_buy") - F.col("strong_sell")) / total), 4)
    df = df.withColumn("target", target)
    return df.withColumns({"upside": R.upside(F.col("target"), F.col("spot")), "buy_ratio": R.buy_ratio([F.col(c) for c in COUNTS]), "momentum_score": R.momentum_score()})


CAND_SQL = f"""{WITH}, {FUND_SQL}, {HV_SQL}, {MACD_SQL}, {RSI_SQL('bars', 'd')}, {RSI_SQL('weeks', 'w')},
hvp as (select symbol, case when max(n) >= 272 then round(100.0 * sum(case when round(hv, 9) <= round(now, 9) then 1 else 0 end) / 252, 6) else 50.0 end as hv_percentile
  from (select *, max(case when back = 1 then hv end) over (partition by symbol) as now from (select *, row_number() over (partition by symbol order by rn desc) as back, count(*) over (partition by symbol) as n from hvs) where back <= 252) group by symbol),
mst as (select symbol, case when old is null or abs(hist - old) / greatest(abs(old), 1e-9) < 0.05 then 'neutral' else case when hist > old then 'subiendo_' else 'bajando_' end || case when hist >= 0 then 'positivo' else 'negativo' end end as macd_state
  from (select *, lag(hist, 3) over (partition by symbol order by rn) as old from macd) qualify row_number() over (partition by symbol order by rn desc) = 1),
dr as (select symbol, rsi as rsi_daily, lag(rsi, 3) over (partition by symbol order by rn) as rsi_daily_3_ago from drsi qualify row_number() over (partition by symbol order by rn desc) = 1),
wr as (select symbol, rsi as rsi_weekly, lag(rsi, 2) over (partition by symbol order by rn) as rsi_weekly_2_ago from wrsi qualify row_number() over (partition by symbol order by rn desc) = 1),
sp as (select symbol, arg_max(close, rn) as spot from bars group by symbol), {CUTS_SQL},
cands as (select *, case when target <> 0 and spot > 0 then target / spot - 1 else 0 end as upside, (strong_buy + buy)::double / (strong_buy + buy + hold + sell + strong_sell) as buy_ratio,
  case when rsi_daily < 50 and rsi_daily > rsi_daily_3_ago then 1 else 0 end + case when rsi_weekly < 50 and rsi_weekly > rsi_weekly_2_ago then 1 else 0 end + case when macd_state like 'subiendo%' then 1 else 0 end as momentum_score
  from (select *, coalesce(cuts.downgrades, 0) as n_cuts, round(spot * (1 + (strong_buy - strong_sell)::double / (strong_buy + buy + hold + sell + strong_sell)), 4) as target from fund join hvp using (symbol) join mst using (symbol) join dr using (symbol) join wr using (symbol) join sp using (symbol) left join cuts using (symbol))),
judged as (select *, case when market_cap < 10e9 then printf('quality_liquidity: market cap (%.1f) < 10000000000', market_cap) when avg_volume < 1e6 then printf('quality_liquidity: avg daily volume (%.1f) < 1000000', avg_volume)
    when sector not in ('Utilities', 'Financial Services', 'Real Estate') and free_cash_flow <= 0 then printf('quality_liquidity: FCF TTM (%.1f) ≤ 0.0', free_cash_flow) end as r1,
  case when upside <= 0 then printf('valuation: price target upside (%.1f', upside * 100) || '%) ≤ 0.0%' when buy_ratio < 0.45 then printf('valuation: buy ratio (%.2f) < 0.45', buy_ratio)
    when n_cuts > 1 and (country is null or country not in ({', '.join(repr(x) for x in C.UNRATED_COUNTRIES)})) then 'valuation: ' || n_cuts || ' downgrades en 6w > 1' end as r2,
  case when rsi_daily >= 70 then printf('momentum: RSI_d sobrecomprado (%.1f ≥ 70.0)', rsi_daily) when rsi_weekly >= 70 then printf('momentum: RSI_w sobrecomprado (%.1f ≥ 70.0)', rsi_weekly) end as r3,
  case when hv_percentile > 90 then printf('hv_percentile: HV percentile %.1f > 90.0', hv_percentile) when hv_percentile < 30 then printf('hv_percentile: HV percentile %.1f < 30.0', hv_percentile) end as r4 from cands)"""


@query(f"{CAND_SQL} select symbol, round(upside, 6) as upside, cast(momentum_score as integer) as momentum_score from cands")
def momentum_score(spark, sf_dir):
    return candidates(spark, sf_dir).select("symbol", r6("upside", "upside"), "momentum_score")


@query(f"{CAND_SQL} select symbol, concat_ws(' | ', r1, r2, r3, r4) as reasons, concat_ws('', r1, r2, r3, r4) = '' as passed from judged")
def step1_reasons(spark, sf_dir):
    return R.screened(candidates(spark, sf_dir)).select("symbol", F.array_join("reasons", " | ").alias("reasons"), "passed")




def _filter_query(name, rule, number):
    @query(f"{CAND_SQL} select symbol, regexp_replace(r{number}, '^[a-z_]+: ', '') as reason from judged")
    def run(spark, sf_dir):
        return candidates(spark, sf_dir).select("symbol", rule().alias("reason"))

    return run


for _i, (_name, _rule) in enumerate((("filter_quality", R.quality), ("filter_valuation", R.valuation), ("filter_momentum", R.momentum), ("filter_hv", R.volatility)), 1):
    from confluence.plans import catalog as _catalog

    _run = _filter_query(_name, _rule, _i)
    _catalog.QUERIES[_name], _catalog.SQL[_name] = _catalog.QUERIES.pop("run"), _catalog.SQL.pop("run")

TODAY = "2001-10-26"


@query(f"with {MACRO_SQL} select date, kind, description, cast(date - date '{TODAY}' as integer) as days_until from macro where date - date '{TODAY}' between 0 and 45")
def macro_window(spark, sf_dir):
    return E.macro_window(macro(spark, sf_dir), F.lit(TODAY).cast("date"))


@query(f"with {MACRO_SQL} select count(*) as n, to_json(list({{'date': date, 'kind': kind, 'description': description}} order by date, kind)) as events from macro where date - date '{TODAY}' between 0 and 45")
def macro_json(spark, sf_dir):
    near = E.macro_window(macro(spark, sf_dir), F.lit(TODAY).cast("date"))
    return near.agg(F.count("*").alias("n"), E.as_json(near).alias("events"))


@query(f"with {MACRO_SQL} select date, cast(date - date '{TODAY}' as integer) as days_until, upper(kind) as kind, case when kind = 'other' then '—' else 'US' end as jurisdiction, description from macro where date - date '{TODAY}' between 0 and 45")
def macro_banner(spark, sf_dir):
    return E.macro_banner(macro(spark, sf_dir), F.lit(TODAY).cast("date"))


SQL_OF_EVENTS = f"""with {MACRO_SQL}, own as (select distinct p_type as symbol from part), e as (select symbol, date '{TODAY}' + case when symbol < 'M' then 10 else 60 end as earnings_date from own where symbol <> 'PROMO'), d as (select symbol, date '{TODAY}' + case when symbol > 'S' then 20 else -3 end as ex_div_date, case when symbol <> 'STANDARD' then 0.5::double end as ex_div_amount from own where symbol > 'M'),
m as (select count(*) as macro_count, string_agg(distinct kind, ', ' order by kind) as macro_kinds from macro where date - date '{TODAY}' between 0 and 45)
select symbol, cast(earnings_date as date) as earnings_date, cast(earnings_date - date '{TODAY}' as integer) as days_to_earnings, coalesce(earnings_date - date '{TODAY}' between 0 and 45, false) as earnings_near, cast(ex_div_date as date) as ex_div_date, cast(ex_div_date - date '{TODAY}' as integer) as days_to_ex_div,
  coalesce(ex_div_date - date '{TODAY}' between 0 and 45, false) as ex_div_near, ex_div_amount, macro_count, macro_kinds, true as has_events, concat_ws(' | ', case when earnings_date - date '{TODAY}' between 0 and 45 then 'Earnings en ' || (earnings_date - date '{TODAY}') || ' días (' || earnings_date || ')' end,
    case when ex_div_date - date '{TODAY}' between 0 and 45 then 'Ex-dividend en ' || (ex_div_date - date '{TODAY}') || ' días' || case when ex_div_amount is null then '' else ' (€0.50)' end end) as flags
from own left join e using (symbol) left join d using (symbol), m"""


@query(SQL_OF_EVENTS)
def binary_events(spark, sf_dir):
    own = tape.read(spark, sf_dir, "part").select(F.col("p_type").alias("symbol")).distinct().withColumn("currency", F.lit("EUR"))
    today = F.lit(TODAY).cast("date")
    earnings = own.filter("symbol <> 'PROMO'").select("symbol", F.date_add(today, F.when(F.col("symbol") < "M", 10).otherwise(60)).alias("date"))
    dividends = own.filter("symbol > 'M'").select("symbol", F.date_add(today, F.when(F.col("symbol") > "S", 20).otherwise(-3)).alias("date"), F.when(F.col("symbol") != "STANDARD", 0.5).alias("amount"))
    return E.binary_events(own, earnings, dividends, macro(spark, sf_dir), today).select("symbol", "earnings_date", "days_to_earnings", "earnings_near", "ex_div_date", "days_to_ex_div", "ex_div_near", "macro_count", "macro_kinds", "has_events", "flags", "ex_div_amount")


@query("""select symbol, string_agg(universe, ',' order by universe) as universes from (select p_brand as symbol, 'large' as universe from part where p_size >= 45 union select p_brand, 'costly' from part where p_retailprice >= 1800 union select p_brand, 'all' from part) group by symbol""")
def universe_tags(spark, sf_dir):
    part = tape.read(spark, sf_dir, "part").withColumn("symbol", F.col("p_brand"))
    return U.tagged({"large": part.filter("p_size >= 45"), "costly": part.filter("p_retailprice >= 1800"), "all": part}).select("symbol", F.array_join("universes", ",").alias("universes"))


# Endings of the spellings of supplier symbols, by key.
ENDINGS = (".b", " B", " LN", " GR", "/A LN", " GY", ".as", ".y")


@query(f"""with s as (select s_suppkey, 's' || s_suppkey || ({list(ENDINGS)})[s_suppkey % 8 + 1] as symbol, upper('s' || s_suppkey) as base, s_suppkey % 8 as k from supplier)
select symbol, replace(upper(symbol), '.', '-') as dashed, replace(upper(symbol), ' ', '-') || '.DE' as german, replace(upper(symbol), ' ', '-') || '.L' as irish,
  case k when 2 then base || '.L' when 3 then base || '.DE' when 4 then base || '/A.L' when 6 then base || '.AS' end as market from s""")
def normalize_symbols(spark, sf_dir):
    """Suppliers as symbols in eight spellings."""
    key = F.col("s_suppkey")
    df = tape.read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), key.cast("string"), F.element_at(F.lit(list(ENDINGS)), (key % 8 + 1).cast("int"))).alias("symbol"))
    country = lambda c: U.by_country(F.col("symbol"), F.lit(c))
    return df.select("symbol", U.dashed(F.col("symbol")).alias("dashed"), country("Germany").alias("german"), country("Ireland").alias("irish"), U.by_market(F.col("symbol")).alias("market"))


@query("""select n_name as symbol, case when n_nationkey % 3 = 0 then lower(n_name) || '.us' when n_nationkey % 3 = 1 then lower(n_name) || '.de' end as quoted, n_nationkey % 3 <> 1 as domestic from nation""")
def quote_symbols(spark, sf_dir):
    """Nations as symbols: plain, with a known suffix, and with an unknown one."""
    df = tape.read(spark, sf_dir, "nation")
    form = F.concat("n_name", F.when(F.col("n_nationkey") % 3 == 1, ".DE").when(F.col("n_nationkey") % 3 == 2, ".XX").otherwise(""))
    return df.select(F.col("n_name").alias("symbol"), U.quoted(form).alias("quoted"), U.is_domestic(form).alias("domestic"))


@query("select distinct p_brand as symbol from part order by 1 limit 10")
def universe_limited(spark, sf_dir):
    return U.first_symbols(tape.read(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol")).distinct(), 10)


@query("select distinct o_orderpriority as sector from orders where o_orderkey % 5 <> 0 order by 1")
def sector_list(spark, sf_dir):
    orders = tape.read(spark, sf_dir, "orders")
    return R.sectors(orders.select(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("sector")))


@query("select n_regionkey as page_id, cast(row_number() over (partition by n_regionkey order by n_nationkey) - 1 as integer) as pos, n_name as value from nation")
def table_column_extract(spark, sf_dir):
    """A page for each region: a table without the header asked for, and one of its nations with it."""
    cell = F.format_string('<tr class="r"><td>%d</td><td><a href="/n"> %s </a></td></tr><tr><td>short</td></tr>', F.col("n_nationkey"), F.col("n_name"))
    rows = tape.read(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", cell.alias("row")))).alias("rows"))
    html = F.concat(F.lit("<table><tr><th>Key</th></tr><tr><td>1</td></tr></table><TABLE id=x><tr><th>Key</th><th>Ticker symbol</th></tr>"), F.array_join(F.transform("rows", lambda r: r["row"]), "\n"), F.lit("</TABLE>"))
    return U.table_column(rows.select("page_id", html.alias("html")), ("Ticker symbol", "Symbol"))


@query("""select n_regionkey as page_id, cast(row_number() over (partition by n_regionkey order by s_suppkey) - 1 as integer) as pos, 's&' || s_suppkey || ' b' as ticker,
  case n_nationkey % 5 when 0 then 'France' when 1 then 'Germany' when 2 then 'United Kingdom' else n_name end as country,
  'S&' || s_suppkey || '-B' || case n_nationkey % 5 when 0 then '.PA' when 1 then '.DE' when 2 then '.L' end as symbol
from supplier join nation on s_nationkey = n_nationkey""")
def constituents(spark, sf_dir):
    """A page for each region: its suppliers as tickers with their countries, behind a table without countries, with notes and entities."""
    place = F.col("n_nationkey") % 5
    country = F.when(place == 0, "France").when(place == 1, "Germany").when(place == 2, "United Kingdom").otherwise(F.col("n_name"))
    row = F.concat(F.lit("<tr><td> s&amp;"), F.col("s_suppkey"), F.lit(" b<!-- note --></td><td>Co.</td><td><img alt='>'/><a>"), country, F.lit("</a></td>"))
    rows = tape.read(spark, sf_dir, "supplier").join(tape.read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.groupBy(F.col("n_regionkey").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("row")))).alias("rows"))
    head = "<table><tr><th>Ticker</th></tr><tr><td>x</td></tr></table><table><tr><th>Ticker</th><th>Company</th><th>Country</th></tr>"
    html = F.concat(F.lit(head), F.array_join(F.transform("rows", lambda r: r["row"]), "</tr>"), F.lit("</tr></table>"))
    return U.constituents(rows.select("page_id", html.alias("html")))


@query("""select case c_custkey % 5 when 3 then 'Ñ' || c_custkey || ' ' || c_mktsegment else upper('c' || c_custkey || '.' || case when c_custkey % 5 = 4 then 'ñ' else '' end || left(c_mktsegment, 1)) end as symbol, c_custkey % 5 <> 3 as valid
from customer where c_custkey % 5 not in (0, 1)""")
def watchlist_parse(spark, sf_dir):
    """Customers as lines of a watchlist: comments, blank lines, symbols with comments behind, two words, signs of other scripts."""
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    name = F.concat(F.lit("c"), key.cast("string"), F.lit("."), F.when(key % 5 == 4, "ñ").otherwise(""), F.lower(F.left(segment, F.lit(1))))
    line = (
        F.when(key % 5 == 0, F.concat(F.lit("# "), segment)).when(key % 5 == 1, "  ").when(key % 5 == 2, F.concat(F.lit(" "), name, F.lit(" # "), segment))
        .when(key % 5 == 3, F.concat(F.lit("ñ"), key.cast("string"), F.lit(" "), segment)).otherwise(name)
    )
    return U.watchlist(tape.read(spark, sf_dir, "customer").select(line.alias("value")))


@query("""select page_id, cast(i - 1 as integer) as pos, trim(regexp_replace(raw, '<[^>]*>', '', 'g')) as cell from (select page_id, unnest(found) as raw, generate_subscripts(found, 1) as i from (select page_id, regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1) as found from pages))""")
def html_table_extract(spark, sf_dir):
    return U.cells(tape.read(spark, sf_dir, "pages"))


@query("""select user_id, source, round(value, 6) as value from (select user_id, event_type as source, arg_max(value, (ts, event_id)) as value, case event_type when 'purchase' then 0 when 'signup' then 1 when 'view' then 2 end as rank from events where event_type in ('purchase', 'signup', 'view') group by user_id, event_type) qualify row_number() over (partition by user_id order by rank) = 1""")
def source_fallback(spark, sf_dir):
    ev = tape.read(spark, sf_dir, "events")
    latest = ev.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    sources = {t: latest.filter(F.col("event_type") == t).select("user_id", "value") for t in ("purchase", "signup", "view")}
    return S2.resolved(sources, ["user_id"]).select("user_id", "source", r6("value", "value"))


@query("""with d as (select event_id, cast(ts as date) as date, value, (select max(cast(ts as date)) from events) as last from events)
select event_id, date, round(case when date > last - 7 then value + 1 else value end, 6) as value from d""")
def upsert_merge(spark, sf_dir):
    """A cache that ends three days ago, and a refetch of the last seven with corrected values."""
    ev = tape.read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("date").alias("date"), "value")
    ev = ev.crossJoin(F.broadcast(ev.agg(F.max("date").alias("last"))))
    cached = ev.filter(F.col("date") <= F.date_sub("last", 3)).drop("last")
    fresh = ev.filter(F.col("date") > F.date_sub("last", 7)).withColumn("value", F.col("value") + 1).drop("last")
    return S2.merged(cached, fresh, ["event_id"]).select("event_id", "date", r6("value", "value"))


@query(f"{WITH}, c as (select symbol from bars group by symbol having min(date) <= date '1998-01-05' and max(date) >= date '1998-12-31') select symbol, date, close from bars join c using (symbol) where date between date '1998-01-05' and date '1998-12-31'")
def coverage_slice(spark, sf_dir):
    return S2.covered(tape.bars(spark, sf_dir), "1998-01-05", "1998-12-31", ["symbol"]).select("symbol", "date", "close")


@query("""select event_id, case event_id % 6 when 0 then 'upgrade' when 1 then 'downgrade' when 2 then 'initiation' when 3 then 'reiterated' when 4 then 'hold it' else '' end as action,
  case event_id % 4 when 0 then value end as number, case event_id % 4 when 0 then cast(trunc(value) as bigint) else 0 end as whole, case when event_id % 3 = 0 then null else event_type end as text, case when event_id % 2 = 0 then cast(ts as date) end as day from events""")
def cleaned_fields(spark, sf_dir):
    """Events as a raw source gives them: numbers as text, some of them NaN, words or nothing; actions in many spellings; empty texts; broken dates."""
    ev = tape.read(spark, sf_dir, "events")
    pick = lambda c, *values: F.element_at(F.array(*[v if not isinstance(v, str) else F.lit(v) for v in values]), (F.col(c) % len(values)).cast("int") + 1)
    raw = pick("event_id", F.col("value").cast("string"), "NaN", "n/a", "")
    action = F.when(F.col("event_id") % 6 != 5, pick("event_id", "Up", " down", "INIT", "reit ", "Hold it", ""))
    day = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("soon")
    return ev.select("event_id", J.rating_action(action).alias("action"), J.clean_number(raw).alias("number"), J.clean_count(raw).alias("whole"), J.clean_text(F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type"))).alias("text"), J.clean_date(day).alias("day"))


@query("""with own as (select user_id, case event_type when 'purchase' then '0m' when 'signup' then '-1m' else '-2m' end as period, count(*) as buy, sum(event_id % 7) as hold, sum(event_id % 3) as strong_sell from events where user_id % 3 = 0 or event_type <> 'purchase' and user_id % 3 = 1 or event_type = 'view' group by 1, 2),
best as (select user_id, arg_min((buy, hold, strong_sell), case period when '0m' then 1 when '-1m' then 2 end) filter (period in ('0m', '-1m')) as b from own group by user_id)
select user_id as symbol, 0::bigint as strong_buy, coalesce(b[1], 0)::bigint as buy, coalesce(b[2], 0)::bigint as hold, 0::bigint as sell, coalesce(b[3], 0)::bigint as strong_sell,
  round((2 * coalesce(b[1], 0) + 3 * coalesce(b[2], 0) + 5 * coalesce(b[3], 0))::double / nullif(coalesce(b[1], 0) + coalesce(b[2], 0) + coalesce(b[3], 0), 0), 6) as mean from best""")
def recommendations_latest(spark, sf_dir):
    """Users as symbols: opinions of this month, or else of the last one, or else none."""
    ev = tape.read(spark, sf_dir, "events").filter("user_id % 3 = 0 or event_type <> 'purchase' and user_id % 3 = 1 or event_type = 'view'")
    period = F.when(F.col("event_type") == "purchase", "0m").when(F.col("event_type") == "signup", "-1m").otherwise("-2m")
    rows = ev.groupBy(F.col("user_id").alias("symbol"), period.alias("period")).agg(F.lit("").alias("strong_buy"), F.count("*").alias("buy"), F.sum(F.col("event_id") % 7).alias("hold"), F.lit(None).cast("string").alias("sell"), F.sum(F.col("event_id") % 3).cast("string").alias("strong_sell"))
    counts = J.recommendation_counts(rows)
    return counts.withColumn("mean", F.round(J.recommendation_mean([F.col(c) for c in J.COUNTS]), 6))


@query("""select o_custkey as symbol, min(cast(o_orderdate as date)) as date from orders where cast(o_orderdate as date) between date '1997-03-01' and date '1997-03-01' + 45 group by 1""")
def upcoming_events(spark, sf_dir):
    orders = tape.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("symbol"), F.col("o_orderdate").cast("date").alias("date"))
    return J.upcoming(orders, F.lit("1997-03-01").cast("date"), C.EVENT_DAYS)


@query("""select l_partkey as symbol, max((cast(l_shipdate as date), l_extendedprice))[2] as amount from lineitem group by 1""")
def last_dividends(spark, sf_dir):
    lines = tape.read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("symbol"), F.col("l_shipdate").cast("date").alias("date"), F.col("l_extendedprice").alias("amount"))
    return J.last_dividend(lines)


@query("""select o_custkey as symbol, (max((cast(o_orderdate as date), o_totalprice)) filter (o_orderstatus = 'F'))[2] as revenue, (max((cast(o_orderdate as date), o_totalprice)) filter (o_orderstatus = 'O'))[2] as cash from orders group by 1""")
def statement_latest(spark, sf_dir):
    """Customers as symbols: finished orders are revenue, open ones cash."""
    label = F.when(F.col("o_orderstatus") == "F", "revenue").when(F.col("o_orderstatus") == "O", "cash")
    rows = tape.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("symbol"), label.alias("label"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("value"))
    return J.latest_values(rows, ("revenue", "cash"))

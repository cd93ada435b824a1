"""Queries over the run history, the read side and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from confluence.functions import series as S
from confluence.functions import strikes as K
from confluence.operators import history as H
from confluence.operators import report as P
from confluence.operators.filters import state_predicate
from confluence.operators.narrative import narrative
from confluence.operators.regime import LEGACY, classified
from confluence.plans.catalog import query
from confluence.plans import q_filters, screen
from confluence.plans.q_classify import CLASSIFY_SQL, LABEL_SQL, facts, past_sql
from confluence.plans.q_levels import ZONE_SQL, inputs, zones_of
from confluence.plans.q_series import MACD_SQL, WITH, r6
from confluence.sources import tape


#: The day as of which the report is shown, and when it is said to have been made.
SHOWN, TOLD = "2001-06-15", "2001-10-26T09:00:00"
LEGACY_SQL = " ".join(f"when '{k}' then '{v}'" for k, v in LEGACY.items())
TIERS = " ".join(f"when {k} then '{v}'" for k, v in P.TIER_LABELS.items())
ELEMENTS = " ".join(f"when '{k}' then '{v}'" for k, v in P.ELEMENT_LABELS.items())
EVENTS_SQL = "ev_own as (" + q_filters.SQL_OF_EVENTS + ")"
#: Step-1 facts behind CLASSIFY_SQL, whose bars and MACD they share.
FACTS_SQL = q_filters.CAND_SQL.replace(f"{WITH}, ", "").replace(f"{MACD_SQL}, ", "")
STRIKES_SQL = """floor(greatest(upper, spot - atr) / grid + 0.5) * grid as strike_aggressive, floor(center / grid + 0.5) * grid as strike_natural, floor((lower - atr) / grid + 0.5) * grid as strike_conservative"""
STORY_SQL = f"""{CLASSIFY_SQL}, {FACTS_SQL}, {EVENTS_SQL},
story as (select *, {STRIKES_SQL} from (select z.*, s.atr, c.legacy, d.rsi_daily, d.rsi_daily_3_ago, m.macd_state, e.* exclude (symbol), cast(case when z.spot <= 25 then 0.5 when z.spot <= 100 then 1 when z.spot <= 250 then 2.5 else 5 end as double) as grid
  from zones z join spots s using (symbol) left join (select symbol, case primary_trigger {LEGACY_SQL} end as legacy from classes) c on c.symbol = z.symbol join dr d on d.symbol = z.symbol join mst m on m.symbol = z.symbol left join ev_own e on e.symbol = z.symbol where zone_id = 0))"""
SELECTED_SQL = past_sql(f"""{CLASSIFY_SQL}, {FACTS_SQL}, {EVENTS_SQL},
labels as (select string_agg(case element {ELEMENTS} end, ' | ' order by price, element, detail) as elementos_score, symbol, cluster from clus group by symbol, cluster),
sel as (select *, {STRIKES_SQL} from (select j.symbol, concat_ws('', r1, r2, r3, r4) = '' as passed, z.symbol is not null as zone, c.regime, c.primary_trigger, c.triggers, {LABEL_SQL.replace('regime', 'c.regime', 1)} as composite_label, z.lower as zona_min, z.upper as zona_max, z.distance as distancia_pct,
    printf('%.1f', z.score) as score_soporte, cast(z.n_elements as bigint) as n_elementos, l.elementos_score, z.dynamic as confirmador_dinamico, j.rsi_daily as rsi_diario, j.macd_state as macd_estado, j.momentum_score, k.a > k.b as sma50w_sobre_sma200w, j.hv_percentile as hv,
    round((1.0 * j.strong_buy + 2 * j.buy + 3 * j.hold + 4 * j.sell + 5 * j.strong_sell)::double / (j.strong_buy + j.buy + j.hold + j.sell + j.strong_sell), 6) as recommendation_mean, j.n_cuts as downgrades_6w, e.earnings_date, e.flags as flags_legibles, e.has_events, z.signals, z.lower, z.upper, z.center, j.spot, s.atr,
    cast(case when j.spot <= 25 then 0.5 when j.spot <= 100 then 1 when j.spot <= 250 then 2.5 else 5 end as double) as grid
  from judged j join spots s on s.symbol = j.symbol left join zones z on z.symbol = j.symbol and z.is_valid and z.zone_id = 0 left join labels l on l.symbol = z.symbol and l.cluster = z.cluster left join classes c on c.symbol = j.symbol left join wk k on k.symbol = j.symbol left join ev_own e on e.symbol = j.symbol))""", SHOWN)


def runs(spark, sf_dir):
    """A run for each order day: its orders are the universe, finished ones the candidates."""
    orders = tape.read(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    return orders.groupBy(day.alias("started_at")).agg(F.date_format(F.first(day), "yyyyMMdd").alias("run_id"), F.count("*").alias("universe_size"), F.count_if(F.col("o_orderstatus") == "F").alias("candidates_passed"))


@query("select strftime(cast(o_orderdate as date), '%Y%m%d') as run_id, cast(o_orderdate as date) as started_at, count(*) as universe_size, count(*) filter (o_orderstatus = 'F') as candidates_passed from orders group by 1, 2 order by started_at desc limit 20")
def runs_recent(spark, sf_dir):
    return H.recent_runs(runs(spark, sf_dir), 20)


BEST_SQL = """z as (select l_orderkey, l_linenumber, l_extendedprice as score, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber, l_partkey) = 1 as is_best from lineitem),
cb as (select o_orderkey as run_id, o_orderpriority as sector, z.l_linenumber as zone, z.score, case o_orderstatus when 'F' then 'downtrend' when 'O' then 'uptrend' end as regime,
  case o_orderkey % 3 when 0 then 'range_floor' when 1 then 'capitulation_reclaim' end as primary_trigger from orders o left join z on z.l_orderkey = o.o_orderkey and z.is_best)"""


def best(spark, sf_dir):
    """Orders as candidates with their dearest line as best zone, and facts for the read side's filters."""
    line = F.struct(F.col("l_extendedprice").alias("score"), -F.col("l_linenumber"), -F.col("l_partkey"), F.col("l_linenumber").alias("zone"))
    z = tape.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.max(line).alias("line"))
    z = z.select("run_id", F.col("line.zone").alias("zone"), F.col("line.score").alias("score"), F.lit(True).alias("is_best"))
    key = F.col("o_orderkey")
    regime = F.when(F.col("o_orderstatus") == "F", "downtrend").when(F.col("o_orderstatus") == "O", "uptrend")
    c = tape.read(spark, sf_dir, "orders").select(
        key.alias("run_id"), F.col("o_orderpriority").alias("sector"), regime.alias("regime"), F.when(key % 3 == 0, "range_floor").when(key % 3 == 1, "capitulation_reclaim").alias("primary_trigger"),
        (key % 2 == 0).alias("earnings_near"), (key % 5 != 0).alias("ex_div_near"), (key % 7 != 0).alias("macro_near"), (key % 4 == 0).alias("wheel"),
    )
    return H.with_best_zone(c, z, ["run_id"]).drop("is_best")


@query(f"with {BEST_SQL} select run_id, sector, zone, score from cb")
def candidates_best_zone(spark, sf_dir):
    return best(spark, sf_dir).select("run_id", "sector", "zone", "score")


@query(f"""with {BEST_SQL} select run_id, sector, zone, score from cb where sector in ('1-URGENT', '2-HIGH') and score >= 30000 and regime in ('downtrend', 'uptrend')
  and primary_trigger = 'range_floor' and run_id % 2 = 0 and run_id % 5 <> 0 and run_id % 7 <> 0 and run_id % 4 = 0""")
def filter_state(spark, sf_dir):
    """All eight criteria at once."""
    asked = state_predicate(("downtrend", "uptrend"), ("range_floor",), ("1-URGENT", "2-HIGH"), 30000.0, earnings=True, ex_div=True, macro=True, wheel_only=True)
    return best(spark, sf_dir).filter(asked).select("run_id", "sector", "zone", "score")


@query(f"with {BEST_SQL} select run_id, sector, zone, score from cb where run_id % 2 <> 0 and run_id % 5 = 0")
def filter_state_open(spark, sf_dir):
    """Flags asked to be False; what isn't asked filters nothing, nulls included."""
    return best(spark, sf_dir).filter(state_predicate(earnings=False, ex_div=False)).select("run_id", "sector", "zone", "score")


@query(f"""{CLASSIFY_SQL} select c.symbol, legacy, case when legacy = 'T1' then 1 when legacy = 'T2' then 2 when legacy = 'T4' then 3 when legacy = 'T3' then 4 when legacy = 'T5' then 5 else 99 end as priority, round(score, 5) as score, round(distance, 6) as distance
from (select *, case primary_trigger {LEGACY_SQL} end as legacy from classes) c left join zones z on z.symbol = c.symbol and z.zone_id = 0""")
def report_order(spark, sf_dir):
    z = zones_of(spark, sf_dir)
    df = classified(facts(spark, sf_dir)).join(z.filter("zone_id = 0").select("symbol", "score", "distance"), "symbol", "left")
    return P.ordered(df.withColumn("priority", P.priority(F.col("legacy")))).select("symbol", "legacy", "priority", r6("score", "score", 5), r6("distance", "distance"))


@query(f"{ZONE_SQL} select symbol, zone_id, case when width_pct < 0.02 then 'compacta' when width_pct < 0.035 then 'ajustada' else 'amplia' end as width, repeat('⭐', tier) as stars, case tier {TIERS} end as label from zones")
def zone_words(spark, sf_dir):
    z = zones_of(spark, sf_dir)
    return z.select("symbol", F.col("zone_id").cast("long").alias("zone_id"), P.width_word(F.col("width_pct")).alias("width"), P.stars(F.col("tier")).alias("stars"), P.tier_label(F.col("tier")).alias("label"))


@query(f"{ZONE_SQL}, el as (select symbol, cluster, row_number() over (partition by symbol, cluster order by w desc, price, element, detail) as k, case element {ELEMENTS} end as label from clus) select symbol, zone_id, string_agg(label, ' | ' order by k) as elements from zones join el using (symbol, cluster) group by symbol, zone_id")
def zone_elements(spark, sf_dir):
    """A zone's elements, heaviest first, by their labels."""
    own = F.transform(P.by_weight(F.col("held")), lambda e: P.element_label(e["element"]))
    return zones_of(spark, sf_dir).select("symbol", F.col("zone_id").cast("long").alias("zone_id"), F.array_join(own, " | ").alias("elements"))


def story(spark, sf_dir, today=None):
    """Each symbol's first zone with the facts that reports tell."""
    z = zones_of(spark, sf_dir, today).filter("zone_id = 0").drop("reasons")
    classes = classified(facts(spark, sf_dir, today)).select("symbol", "legacy")
    lags = q_filters.series_facts(*inputs(spark, sf_dir, today)[:2]).drop("spot")
    events = q_filters.binary_events(spark, sf_dir)
    df = z.join(classes, "symbol", "left").join(lags, "symbol").join(events, "symbol", "left").withColumns({"currency": F.lit("EUR"), "macro_near": F.col("macro_count") > 0})
    return df.withColumns(K.strikes(*[F.col(c) for c in ("lower", "upper", "center", "spot", "atr")], F.col("currency")))


@query(f"""{STORY_SQL},
heavy as (select symbol, element, cat, w, row_number() over (partition by symbol order by price, element, detail) as pos from clus join story using (symbol, cluster) where w >= 2.5),
said as (select symbol, cat, min(pos) as pos, arg_min(element, pos) as element from heavy group by symbol, cat),
phr as (select symbol, count(*) as n, string_agg(case cat when 'avwap' then 'el AVWAP desde ' || case element when 'avwap_pivot_low' then 'el último pivot bajo' else 'earnings' end || ' como precio promedio de acumulación reciente'
    when 'sma_200' then 'la SMA200 como referencia institucional de largo plazo' when 'sma_50' then 'la SMA50 como soporte de mediano plazo' else 'una resistencia rota previamente que ahora opera como soporte' end, '; ' order by pos) as phrases from said group by symbol)
select symbol, case when legacy is null then '' else '<p><strong>Situación.</strong> ' || symbol || ' está en un contexto <strong>' || legacy || '</strong> (' ||
    case legacy when 'T1' then 'tendencia alcista intacta con pullback a soporte' when 'T2' then 'pánico de mercado o spike de IV' when 'T3' then 'lateralización en zona técnica' else 'post-earnings dip con tendencia intacta' end || ').' ||
    case when rsi_daily < 50 and rsi_daily > rsi_daily_3_ago then printf(' RSI diario en %.0f con giro al alza desde %.0f.', round_even(rsi_daily, 0), round_even(rsi_daily_3_ago, 0)) else '' end ||
    case when macd_state like 'subiendo%' then ' MACD virando a positivo.' else '' end || case when rsi_daily >= 70 then printf(' Atención: RSI diario en zona de sobrecompra (%.0f).', round_even(rsi_daily, 0)) else '' end || '</p>' || chr(10) end ||
  printf('<p><strong>Zona.</strong> La zona detectada está en €%.2f – €%.2f (ancho %.1f', lower, upper, width_pct * 100) || '%, ' || case when width_pct < 0.02 then 'compacta' when width_pct < 0.035 then 'ajustada' else 'amplia' end || ').' ||
    case when n = 1 then ' Anclada en ' || phrases || '.' when n > 1 then ' Anclada en ' || n || ' elementos heavy: ' || phrases || '.' else '' end ||
    printf(' El precio está a %.1f', distance * 100) || '% del techo de la zona, ' || case when distance < 0.08 then 'dentro del rango operable' else 'al límite del rango operable' end || '.</p>' || chr(10) ||
  printf('<p><strong>Qué mirar.</strong> Si el precio cierra debajo del conservative (€%.2f), conviene revisar la tesis.', strike_conservative) ||
    case when earnings_near then ' Earnings en ' || days_to_earnings || ' días — considerar dimensionar la posición para evento o evitar strikes que asignen alrededor del reporte.' else '' end ||
    case when ex_div_near then ' Ex-dividend en ' || days_to_ex_div || ' días' || case when ex_div_amount is null then '' else printf(' ($%.2f)', ex_div_amount) end || ' — riesgo de asignación temprana del put si la opción queda ITM en esa fecha.' else '' end ||
    case when macro_count > 0 then ' Eventos macro en ventana: ' || macro_kinds || '.' else '' end || '</p>' as text
from story left join phr using (symbol)""")
def narrative_text(spark, sf_dir):
    return story(spark, sf_dir).select("symbol", narrative().alias("text"))


@query(f"""{STORY_SQL}, c as (select symbol, close, date, row_number() over (partition by symbol order by date desc) as back from bars qualify back <= 126),
ends as (select s.*, n, least(lo, lower, strike_conservative, strike_natural, strike_aggressive) as least, greatest(hi, upper, strike_conservative, strike_natural, strike_aggressive) as most, last, day
  from story s join (select symbol, count(*) as n, min(close) as lo, max(close) as hi, arg_max(close, date) as last, min(date) as day from c group by symbol) using (symbol)),
yy as (select symbol, n, last, day, least, most, 10 as py, (most - least) * 1.1 as height, least - 0.05 * (most - least) as bottom, lower, upper, strike_aggressive, strike_natural, strike_conservative from ends),
pts as (select symbol, string_agg(printf('%.1f,%.1f', 28 + pos * 424.0::double / (n - 1), 10 + (1 - (close - bottom) / height) * 180.0), ' ' order by pos) as points from (select *, row_number() over (partition by symbol order by date) - 1 as pos from c) join yy using (symbol) group by symbol)
select symbol, case when n < 30 or most = least then '' else concat_ws(chr(10), '<svg viewBox="0 0 480 200" xmlns="http://www.w3.org/2000/svg" role="img" aria-label="Precio últimos 6 meses con zona de soporte y strikes sugeridos">',
  printf('<rect x="28.0" y="%.1f" width="424.0" height="%.1f" fill="#fbbf24" fill-opacity="0.18"/>', 10 + (1 - (upper - bottom) / height) * 180.0, (10 + (1 - (lower - bottom) / height) * 180.0) - (10 + (1 - (upper - bottom) / height) * 180.0)),
  {', '.join(f"""printf('<line x1="28.0" x2="452.0" y1="%.1f" y2="%.1f" stroke="{color}" stroke-width="1.2" stroke-dasharray="3 3"/>', 10 + (1 - (strike_{k} - bottom) / height) * 180.0, 10 + (1 - (strike_{k} - bottom) / height) * 180.0)""" for k, color in (("aggressive", "#dc2626"), ("natural", "#f97316"), ("conservative", "#16a34a")))},
  '<polyline points="' || points || '" fill="none" stroke="currentColor" stroke-width="1.4" opacity="0.85"/>', printf('<circle cx="452.0" cy="%.1f" r="3.5" fill="currentColor"/>', 10 + (1 - (last - bottom) / height) * 180.0),
  printf('<text x="2" y="18.0" font-size="8" fill="currentColor" opacity="0.55">€%.2f</text>', most), printf('<text x="2" y="190.0" font-size="8" fill="currentColor" opacity="0.55">€%.2f</text>', least),
  '<text x="28.0" y="199.0" font-size="8" fill="currentColor" opacity="0.45">' || day(day) || ' ' || ['ene', 'feb', 'mar', 'abr', 'may', 'jun', 'jul', 'ago', 'sep', 'oct', 'nov', 'dic'][month(day)] || '</text>',
  '<text x="452.0" y="199.0" font-size="8" fill="currentColor" opacity="0.45" text-anchor="end">hoy</text>', '</svg>') end as svg from yy join pts using (symbol)""")
def mini_chart(spark, sf_dir):
    bars, _, _ = inputs(spark, sf_dir)
    return P.chart(bars, story(spark, sf_dir))


@query(f"""{WITH}, c as (select symbol, close, date, row_number() over (partition by symbol order by date desc) as back from bars qualify back <= 126),
s as (select *, row_number() over (partition by symbol order by date) - 1 as pos, count(*) over (partition by symbol) as n, min(close) over (partition by symbol) as lo, max(close) over (partition by symbol) as hi from c)
select symbol, cast(pos as integer) as pos, round(28 + pos * 424.0::double / (n - 1), 4) as x, round(190 - (close - (lo - 0.05 * (hi - lo))) / (1.1 * (hi - lo)) * 180.0::double, 4) as y from s where n >= 30 and hi > lo""")
def svg_points(spark, sf_dir):
    return P.chart_points(S.numbered(tape.bars(spark, sf_dir))).select("symbol", "pos", r6("x", "x", 4), r6("y", "y", 4))


@query("""with f as (select distinct strftime(o_orderdate, '%Y-%m-%d') as date, printf('%02d%02d', o_custkey % 24, o_custkey % 60) as hhmm, o_orderkey % 4 as k from orders)
select date, hhmm, 'screening_' || date || '_' || hhmm || '.html' as html, case when bool_or(k = 1) then 'screening_' || date || '_' || hhmm || '.csv' end as csv from f group by date, hhmm having bool_or(k = 0)""")
def history_pairs(spark, sf_dir):
    """Orders as files of reports, half of them of one kind only and some with other names."""
    key, hour = F.col("o_orderkey"), F.format_string("%02d%02d", F.col("o_custkey") % 24, F.col("o_custkey") % 60)
    ending = F.when(key % 4 == 0, ".html").when(key % 4 == 1, ".csv").when(key % 4 == 2, ".txt").otherwise(".html.bak")
    name = F.concat(F.lit("screening_"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("_"), hour, ending)
    return H.report_files(tape.read(spark, sf_dir, "orders").select(name.alias("name")))


def selection(spark, sf_dir, today=None):
    """Every candidate through all steps, as of a day."""
    week = S.last_rows(inputs(spark, sf_dir, today)[1].select("symbol", "date", (S.sma(F.col("close"), 50) > S.sma(F.col("close"), 200)).alias("weeks_rising"))).drop("date")
    mean = q_filters.buy_ratio(spark, sf_dir).select("symbol", "recommendation_mean")
    found = q_filters.candidates(spark, sf_dir, today).join(week, "symbol").join(mean, "symbol").withColumn("universes", F.array(F.lit("all")))
    events = q_filters.binary_events(spark, sf_dir).withColumn("macro_near", F.col("macro_count") > 0)
    rows = screen.selected(found, zones_of(spark, sf_dir, today), classified(facts(spark, sf_dir, today)), events)
    return rows.withColumns({"exchange": F.lit("XTAP"), "fetched_at": F.lit(TOLD)})


@query(f"{SELECTED_SQL} select count(*) as universe, count(*) filter (passed) as step1, count(*) filter (passed and zone) as step2, count(*) filter (passed and zone and primary_trigger is not null) as classified, count(*) filter (passed and zone and primary_trigger is not null) as final, count(*) filter (passed and zone and primary_trigger is not null and has_events) as flagged from sel")
def funnel(spark, sf_dir):
    return screen.funnel(selection(spark, sf_dir, SHOWN))


@query(f"""{SELECTED_SQL} select symbol as ticker, composite_label, round(zona_min, 5) as zona_min, round(zona_max, 5) as zona_max, round(distancia_pct, 6) as distancia_pct, score_soporte, n_elementos, elementos_score, confirmador_dinamico, round(rsi_diario, 4) as rsi_diario,
  macd_estado, cast(momentum_score as integer) as momentum_score, sma50w_sobre_sma200w, round(hv, 5) as hv_percentile_52w, round(recommendation_mean, 6) as recommendation_mean, downgrades_6w, cast(earnings_date as varchar) as earnings_date, flags_legibles, 'all' as universes, signals as momentum_signals,
  round(strike_aggressive, 4) as strike_aggressive, round(strike_natural, 4) as strike_natural, round(strike_conservative, 4) as strike_conservative, regime, primary_trigger, triggers, '{TOLD}' as fetched_at from sel where passed and zone and primary_trigger is not null""")
def report_csv_rows(spark, sf_dir):
    """Columns of the report whose candidates pass every step as of a day."""
    df = screen.report_rows(selection(spark, sf_dir, SHOWN))
    digits = {"zona_min": 5, "zona_max": 5, "distancia_pct": 6, "rsi_diario": 4, "hv_percentile_52w": 5, "recommendation_mean": 6, "strike_aggressive": 4, "strike_natural": 4, "strike_conservative": 4}
    plain = ("ticker", "composite_label", "score_soporte", "n_elementos", "elementos_score", "confirmador_dinamico", "macd_estado", "momentum_score", "sma50w_sobre_sma200w", "downgrades_6w", "flags_legibles", "universes", "momentum_signals", "regime", "primary_trigger", "triggers", "fetched_at")
    return df.select(*plain, F.col("earnings_date").cast("string").alias("earnings_date"), *[r6(c, c, d) for c, d in digits.items()])


@query("select o_orderkey as symbol, o_custkey % 4 as momentum_score from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
def run_by_momentum(spark, sf_dir):
    """A priority as a run: those of its orders that are finished passed."""
    orders = tape.read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("run_id"), F.col("o_orderkey").alias("symbol"), (F.col("o_custkey") % 4).alias("momentum_score"), (F.col("o_orderstatus") == "F").alias("passed"))
    return H.run_list(orders, "1-URGENT", only_passed=True).select("symbol", "momentum_score")


@query("select l_linenumber as zone, l_extendedprice as score from lineitem where l_orderkey = 1 and cast(l_partkey as varchar) = (select cast(min(l_partkey) as varchar) from lineitem where l_orderkey = 1)")
def candidate_detail(spark, sf_dir):
    lines = tape.read(spark, sf_dir, "lineitem")
    first = lines.filter("l_orderkey = 1").agg(F.min("l_partkey").cast("string").alias("p")).first().p or ""
    rows = lines.select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").cast("string").alias("symbol"), F.col("l_linenumber").alias("zone"), F.col("l_extendedprice").alias("score"))
    return H.detail(rows, 1, first).select("zone", "score")


@query("""select strftime(cast(o_orderdate as date), '%Y-%m-%d 00:00') || ' — ' || count(*) filter (o_orderstatus = 'F') || ' candidatos' || case when count(distinct o_orderpriority) filter (o_orderpriority < '3') > 0 then ' (' || string_agg(distinct o_orderpriority, '+' order by o_orderpriority) filter (o_orderpriority < '3') || ')' else '' end as label,
  strftime(cast(o_orderdate as date), '%Y-%m-%d') || ' 09:30 UTC' as file, day(cast(o_orderdate as date)) || ' ' || ['ene', 'feb', 'mar', 'abr', 'may', 'jun', 'jul', 'ago', 'sep', 'oct', 'nov', 'dic'][month(cast(o_orderdate as date))] as day from orders group by cast(o_orderdate as date)""")
def run_labels(spark, sf_dir):
    """Order days as runs, urgent priorities as universes."""
    date = F.col("o_orderdate").cast("date")
    tags = F.array_sort(F.collect_set(F.when(F.col("o_orderpriority") < "3", F.col("o_orderpriority"))))
    days = tape.read(spark, sf_dir, "orders").groupBy(date.alias("date")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("passed"), tags.alias("universes"))
    return days.select(H.run_label(F.col("date"), F.col("passed"), F.col("universes")).alias("label"), H.file_label(F.col("date"), F.lit("0930")).alias("file"), P.day_label(F.col("date")).alias("day"))


@query(f"with {BEST_SQL} select run_id, sector, score from cb where sector = '1-URGENT'")
def run_candidates(spark, sf_dir):
    """One run's candidates, best first."""
    rows = best(spark, sf_dir).filter("sector = '1-URGENT'").select("run_id", "sector", "score")
    return H.by_score(rows, "run_id")

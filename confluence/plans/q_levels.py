"""Queries over pivots, support levels and zones."""

from __future__ import annotations

import atexit

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from confluence import config as C
from confluence.functions import series as S
from confluence.functions import strikes as K
from confluence.operators import as_of as A
from confluence.operators import levels as L
from confluence.operators import pivots as P
from confluence.operators import profile as V
from confluence.operators import zones as Z
from confluence.plans.catalog import query
from confluence.plans.q_series import ATR_SQL, MACD_SQL, RSI_SQL, SMA_SQL, WITH, ewm_sql, r6
from confluence.sources import scratch, tape

# Earnings days of the derived universe, the same for all symbols.
EARNINGS = ("1995-02-10", "1996-02-09", "1997-02-14", "1998-02-13", "1999-02-12", "2000-02-11", "2001-02-09", "2001-08-10", "2001-09-14")


#: What has been written, by application, tables and day: bars, weeks, pivots and, once asked for, zones.
_HELD: dict = {}


def held_of(spark, sf_dir, today=None):
    name, now = (spark.sparkContext.applicationId, sf_dir, today), scratch.state(spark, sf_dir)
    if name in _HELD and _HELD[name]["state"] != now:
        _HELD.pop(name)["held"].release()
    if name not in _HELD:
        held = scratch.Held(spark)
        bars = held.written(L.context(S.with_macd(S.with_rsi(S.with_atr(S.numbered(tape.bars(spark, sf_dir), today))))))
        weeks = held.written(S.numbered(S.weekly(bars.select("symbol", "date", "open", "high", "low", "close", "volume"))))
        _HELD[name] = {"held": held, "state": now, "frames": (bars, weeks, held.written(P.pivots(bars)))}
    return _HELD[name]


def inputs(spark, sf_dir, today=None):
    """(bars, weeks, pivots) as of a day: everything that levels and detectors need, from one exchange by symbol.

    They are written once and read by every plan, so plans stay short; when a table's files have changed they are written
    anew.  ``release`` deletes them, the end of the session too.
    """
    return held_of(spark, sf_dir, today)["frames"]


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        release(spark)


def release(spark) -> None:
    """Deletes all that this session holds; frames that read it can't run any more."""
    scratch.release(spark)
    for name in [n for n in _HELD if n[0] == spark.sparkContext.applicationId]:
        _HELD.pop(name)["held"].release()


def earnings(spark, sf_dir, today=None):
    """All symbols' earnings days, as of a day those up to it."""
    symbols = tape.read(spark, sf_dir, "part").select(F.col("p_type").alias("symbol")).distinct()
    return symbols.select("symbol", F.explode(F.array(*[F.lit(d).cast("date") for d in EARNINGS if today is None or d <= today])).alias("date"))


EARNINGS_SQL = "earnings as (select symbol, cast(d as date) as date from (select distinct p_type as symbol from part), (values " + ", ".join(f"('{d}')" for d in EARNINGS) + ") as e(d))"
FULL_SQL = f"""{WITH}, {ATR_SQL}, {RSI_SQL('bars', '')}, {MACD_SQL},
full_bars as (select b.*, a.y as atr, r.rsi, m.hist as macd_hist, max(b.rn) over (partition by b.symbol) as top, last_value(b.close) over (partition by b.symbol order by b.rn rows between unbounded preceding and unbounded following) as spot
  from bars b join atrs a using (symbol, rn) join rsi r using (symbol, rn) join macd m using (symbol, rn))"""
PIVOT_SQL = f"""{FULL_SQL},
around as (select symbol, date, rn, low, high, atr,
    count(*) over (partition by symbol order by rn rows between 5 preceding and 5 following) as n,
    list(low) over (partition by symbol order by rn rows between 5 preceding and 5 following) as lows,
    list(high) over (partition by symbol order by rn rows between 5 preceding and 5 following) as highs,
    max(high) over (partition by symbol order by rn rows between 20 preceding and 1 preceding) as above,
    min(low) over (partition by symbol order by rn rows between 20 preceding and 1 preceding) as below from full_bars),
cand as (select symbol, date, rn, kind, case when kind = 'low' then low else high end as price, atr, case when kind = 'low' then above else below end as back,
    row_number() over (partition by symbol order by rn) as k
  from (select *, case when low = list_min(lows) and len(list_filter(lows, lambda x: x = low)) = 1 then 'low' when high = list_max(highs) and len(list_filter(highs, lambda x: x = high)) = 1 then 'high' end as kind from around where n = 11) where kind is not null),
fold as (
  select symbol, cast(0 as bigint) as k, cast(null as double) as lo, cast(null as double) as hi, false as ok from (select distinct symbol from cand)
  union all
  select c.symbol, c.k,
    case when c.kind = 'low' and coalesce(coalesce(f.hi, c.back) - c.price >= c.atr, false) then c.price else f.lo end,
    case when c.kind = 'high' and coalesce(c.price - coalesce(f.lo, c.back) >= c.atr, false) then c.price else f.hi end,
    coalesce(case when c.kind = 'low' then coalesce(f.hi, c.back) - c.price >= c.atr else c.price - coalesce(f.lo, c.back) >= c.atr end, false)
  from fold f join cand c on c.symbol = f.symbol and c.k = f.k + 1),
pivots as (select c.* from cand c join fold f using (symbol, k) where f.ok),
spots as (select symbol, top, spot, atr from full_bars where rn = top)"""


@query(f"{PIVOT_SQL} select symbol, date, kind, price, round(atr, 5) as atr, back from cand")
def pivot_candidates(spark, sf_dir):
    bars = S.with_atr(S.numbered(tape.bars(spark, sf_dir)))
    return P.candidates(bars).select("symbol", "date", "kind", "price", r6("atr", "atr", 5), "back")


@query(f"{PIVOT_SQL} select symbol, date, kind, price, round(atr, 5) as atr from pivots")
def pivots(spark, sf_dir):
    bars = S.with_atr(S.numbered(tape.bars(spark, sf_dir)))
    return P.pivots(bars).select("symbol", "date", "kind", "price", r6("atr", "atr", 5))


def shown(levels):
    return levels.select("symbol", "element", r6("price", "price", 5), F.col("rn").cast("long").alias("rn"))


MA_SQL = f"""mas as (
  select symbol, rn, close, {SMA_SQL(200)} as sma_200d, {SMA_SQL(50)} as sma_50d from bars),
wmas as (select symbol, rn, {SMA_SQL(200)} as sma_200w, {SMA_SQL(50)} as sma_50w from weeks),
{ewm_sql('e50', 'bars', 'close', '(2.0::double / 51)')}, {ewm_sql('e200', 'bars', 'close', '(2.0::double / 201)')},
ma_wide as (select s.symbol, s.top as rn, m.sma_200d, m.sma_50d, case when s.top >= 199 then e200.y end as ema_200d, case when s.top >= 49 then e50.y end as ema_50d, w.sma_200w, w.sma_50w
  from spots s join mas m on m.symbol = s.symbol and m.rn = s.top join e50 on e50.symbol = s.symbol and e50.rn = s.top join e200 on e200.symbol = s.symbol and e200.rn = s.top
  left join (select * from wmas qualify row_number() over (partition by symbol order by rn desc) = 1) w on w.symbol = s.symbol),
l_ma as (select symbol, element, price, rn, cast(null as varchar) as detail from ma_wide unpivot (price for element in (sma_200d, sma_50d, ema_200d, ema_50d, sma_200w, sma_50w)))"""


@query(f"{PIVOT_SQL}, {MA_SQL} select symbol, element, round(price, 5) as price, rn from l_ma")
def levels_ma(spark, sf_dir):
    bars, weeks, _ = inputs(spark, sf_dir)
    return shown(L.moving_averages(bars, weeks))


POLARITY_SQL = "l_polarity as (select p.symbol, 'polarity' as element, p.price, p.rn, cast(p.date as varchar) as detail from pivots p join spots s using (symbol) where kind = 'high' and p.rn > s.top - 252 and p.price < s.spot)"


@query(f"{PIVOT_SQL}, {POLARITY_SQL} select symbol, element, round(price, 5) as price, rn from l_polarity")
def levels_polarity(spark, sf_dir):
    bars, _, found = inputs(spark, sf_dir)
    return shown(L.polarity(found))


FIB_SQL = """fib_low as (select p.symbol, max(p.rn) as rn, arg_max(p.price, p.rn) as low, max(p.date) as day, any_value(s.spot) as spot from pivots p join spots s using (symbol) where kind = 'low' and p.rn > s.top - 252 group by p.symbol),
fib_both as (select l.symbol, l.rn, l.low, l.day, coalesce((select arg_max(p.price, p.rn) from pivots p where p.symbol = l.symbol and p.kind = 'high' and p.rn > l.rn), l.spot) as high from fib_low l),
l_fib as (select symbol, name as element, high - ratio * (high - low) as price, rn, cast(day as varchar) as detail from fib_both, (values ('fib_618', 0.618::double), ('fib_786', 0.786::double)) as r(name, ratio) where high > low)"""


@query(f"{PIVOT_SQL}, {FIB_SQL} select symbol, element, round(price, 5) as price, rn from l_fib")
def levels_fib(spark, sf_dir):
    bars, _, found = inputs(spark, sf_dir)
    return shown(L.fibonacci(found))


AVWAP_SQL = f"""{EARNINGS_SQL}, anchors as (
  select symbol, 'avwap_pivot_low' as element, max(p.rn) as anchor from pivots p join spots s using (symbol) where kind = 'low' and p.rn > s.top - 252 group by symbol
  union all select symbol, 'avwap_52w_high', arg_min(rn, (-high, rn)) from full_bars where rn > top - 252 and top >= 251 group by symbol
  union all select symbol, 'avwap_earnings', (select min(b.rn) from bars b where b.symbol = e.symbol and b.date >= e.event) from (select e.symbol, max(e.date) as event from earnings e group by e.symbol) e
    where event >= (select min(date) from full_bars f where f.symbol = e.symbol and f.rn > f.top - 252)),
l_avwap as (select a.symbol, a.element, sum((high + low + close) / 3 * volume) / nullif(sum(volume), 0) as price, a.anchor as rn, cast(min(b.date) as varchar) as detail from anchors a join bars b on b.symbol = a.symbol and b.rn >= a.anchor group by a.symbol, a.element, a.anchor)"""


@query(f"{PIVOT_SQL}, {AVWAP_SQL} select symbol, element, round(price, 5) as price, rn from l_avwap where price is not null")
def levels_avwap(spark, sf_dir):
    bars, _, found = inputs(spark, sf_dir)
    return shown(L.anchored_vwap(L.anchors(found, bars, earnings(spark, sf_dir)), bars))


PROFILE_SQL = """prof_year as (select *, min(low) over (partition by symbol) as bottom, (max(high) over (partition by symbol) - min(low) over (partition by symbol)) / 50 as width from full_bars where rn > top - 252 and top >= 251),
prof as (select y.symbol, k as bucket, any_value(bottom) + k * any_value(width) as low_price, any_value(width) as width,
    sum(case when high - low <= 0 then case when greatest(0, least(49, floor((close - bottom) / width))) = k then volume else 0 end
      else greatest(least(high, bottom + k * width + width) - greatest(low, bottom + k * width), 0) / (high - low) * volume end) as volume
  from prof_year y, (select unnest(range(50)) as k) where width > 0 group by y.symbol, k)"""


@query(f"{FULL_SQL}, {PROFILE_SQL} select symbol, cast(bucket as integer) as bucket, round(low_price, 5) as low_price, round(width, 6) as width, round(volume, 3) as volume from prof")
def volume_profile(spark, sf_dir):
    bars = L.context(S.numbered(tape.bars(spark, sf_dir)))
    return L.volume_profile(bars).select("symbol", "bucket", r6("low_price", "low_price", 5), r6("width", "width", 6), r6("volume", "volume", 3))


HVN_SQL = f"""{PROFILE_SQL}, dense as (select p.*, bucket - row_number() over (partition by symbol order by bucket) as run from prof p join (select symbol, quantile_cont(volume, 0.8) as edge from prof group by symbol) e using (symbol) where volume >= edge),
l_hvn as (select symbol, 'hvn' as element, (min(low_price) + max(low_price + width)) / 2 as price, min(bucket) as rn, min(bucket) || '-' || max(bucket) as detail from dense group by symbol, run)"""


@query(f"{FULL_SQL}, {HVN_SQL} select symbol, element, round(price, 5) as price, rn from l_hvn")
def levels_hvn(spark, sf_dir):
    bars = L.context(S.numbered(tape.bars(spark, sf_dir)))
    return shown(L.volume_nodes(L.volume_profile(bars)))


GAP_SQL = """l_gap as (select d.symbol, 'gap_unfilled' as element, (p.high + d.low) / 2 as price, d.rn, cast(d.date as varchar) as detail from full_bars d join full_bars p on p.symbol = d.symbol and p.rn = d.rn - 1
  where p.rn > d.top - 252 and d.low > p.high and not exists (select 1 from bars f where f.symbol = d.symbol and f.rn > d.rn and f.low <= p.high))"""


@query(f"{FULL_SQL}, {GAP_SQL} select symbol, element, round(price, 5) as price, rn from l_gap")
def levels_gap(spark, sf_dir):
    return shown(L.gaps(L.context(S.numbered(tape.bars(spark, sf_dir)))))


DIVERGENCE_SQL = """div_two as (select p.symbol, p.rn, p.price, b.rsi, b.macd_hist, row_number() over (partition by p.symbol order by p.rn desc) as back from pivots p join full_bars b using (symbol, rn) where kind = 'low' and p.rn > b.top - 60),
l_div as (select b.symbol, 'divergence' as element, b.price, b.rn, case when b.rsi > a.rsi and b.macd_hist > a.macd_hist then 'both' when b.rsi > a.rsi then 'rsi' else 'macd' end as detail from div_two b join div_two a on a.symbol = b.symbol and a.back = 2 where b.back = 1 and b.price < a.price and (b.rsi > a.rsi or b.macd_hist > a.macd_hist))"""


@query(f"{PIVOT_SQL}, {DIVERGENCE_SQL} select symbol, element, round(price, 5) as price, rn from l_div")
def levels_divergence(spark, sf_dir):
    bars, _, found = inputs(spark, sf_dir)
    return shown(L.divergences(found))


ALL_SQL = f"""{PIVOT_SQL}, {MA_SQL}, {POLARITY_SQL}, {FIB_SQL}, {AVWAP_SQL}, {HVN_SQL}, {GAP_SQL}, {DIVERGENCE_SQL},
levels as (select l.*, case when l.price < s.spot then 'support' else 'resistance' end as side from (
  select symbol, element, price, rn, detail from l_ma union all select * from l_polarity union all select * from l_fib union all select symbol, element, price, rn, detail from l_avwap where price is not null
  union all select * from l_hvn union all select * from l_gap union all select * from l_div) l join spots s using (symbol))"""


def levels_of(spark, sf_dir, today=None):
    bars, weeks, found = inputs(spark, sf_dir, today)
    return L.all_levels(bars, weeks, found, earnings(spark, sf_dir, today))


@query(f"{ALL_SQL} select symbol, element, round(price, 5) as price, rn, side, detail from levels")
def levels_all(spark, sf_dir):
    return levels_of(spark, sf_dir).select("symbol", "element", r6("price", "price", 5), "rn", "side", "detail")


def zones_of(spark, sf_dir, today=None):
    """Zones as of a day, held with the inputs: the classification and reports read them several times."""
    own = held_of(spark, sf_dir, today)
    if "zones" not in own:
        own["zones"] = own["held"].written(Z.zones(Z.clustered(levels_of(spark, sf_dir, today))))
    return own["zones"]


_weights = "case element " + " ".join(f"when '{k}' then {v}" for k, v in C.WEIGHTS.items()) + " else 0.0 end"
ZONE_SQL = f"""{ALL_SQL},
sup as (select l.*, s.spot, s.atr, cast({_weights} as double) as w, case when element like 'fib%' then 'fibonacci' when element like 'avwap%' then 'avwap' when element in ('sma_200d', 'sma_200w', 'ema_200d') then 'sma_200'
    when element in ('sma_50d', 'sma_50w', 'ema_50d') then 'sma_50' else element end as cat, price - lag(price) over (partition by symbol order by price, element, rn) as step from levels l join spots s using (symbol) where side = 'support'),
clus as (select *, sum(case when step > least(0.4 * atr, 0.01 * spot) then 1 else 0 end) over (partition by symbol order by price, element, rn rows unbounded preceding) as cluster from sup),
zcat as (select symbol, cluster, cat, max(w) as best from clus group by all),
zsum as (select symbol, cluster, any_value(spot) as spot, min(price) as low, max(price) as high, sum(case when w >= 2.5 then 1 else 0 end) as n_heavy,
    bool_or(element like 'avwap%' or element like 'hvn%' or element like 'divergence%') as dynamic, count(*) as n_elements, string_agg(element, ',' order by price, element, detail) as elements,
    coalesce(string_agg(case when element = 'divergence' then detail end, '|' order by price, element, detail), '') as signals from clus group by symbol, cluster),
zraw as (select z.*, (low + high) / 2 as center, low - 0.001 * (low + high) / 2 as lower, high + 0.001 * (low + high) / 2 as upper, (select sum(best) from zcat c where c.symbol = z.symbol and c.cluster = z.cluster) as raw,
    (select count(*) from zcat c where c.symbol = z.symbol and c.cluster = z.cluster) as n_categories from zsum z),
zden as (select *, (upper - lower) / center as width_pct, (spot - upper) / spot as distance, raw * case when n_heavy <= 0 then 1.0 else greatest(0.85, least(1.5, 1 + (n_heavy / greatest((upper - lower) / center, 0.005) - 100.0) * 0.005)) end as score from zraw where (high - low) / center <= 0.04),
zval as (select *, concat_ws(' | ', case when score < 5 then 'score < 5.0' end, case when not dynamic then 'sin confirmador dinámico' end, case when distance < 0 or distance > 0.10 then 'fuera de rango de proximidad (>10% o por encima del spot)' end,
    case when distance < 0.03 then 'zona muy cerca del spot (' || format('{{:.1f}}', distance * 100) || '% < 3%), no accionable para 30-45 DTE' end, case when n_heavy < 2 then 'solo ' || cast(n_heavy as bigint) || ' elementos peso >= 2.5 (requeridos 2)' end) as rejection_reason,
    case when score >= 18 then 5 when score >= 13 then 4 when score >= 9 then 3 when score >= 6.5 then 2 else 1 end as tier from zden),
zones as (select *, rejection_reason = '' as is_valid, row_number() over (partition by symbol order by rejection_reason = '' desc, round(score, 9) desc, round(distance, 9), n_categories desc, cluster) - 1 as zone_id from zval)"""


@query(f"{ZONE_SQL} select symbol, zone_id, round(lower, 5) as lower, round(upper, 5) as upper, round(center, 5) as center, round(distance, 6) as distance, cast(n_elements as bigint) as n_elements, elements, signals from zones")
def zones(spark, sf_dir):
    z = zones_of(spark, sf_dir)
    return z.select("symbol", F.col("zone_id").cast("long").alias("zone_id"), r6("lower", "lower", 5), r6("upper", "upper", 5), r6("center", "center", 5), r6("distance", "distance"), F.col("n_elements").cast("long").alias("n_elements"), F.array_join("elements", ",").alias("elements"), F.array_join("signals", "|").alias("signals"))


@query(f"{ZONE_SQL} select symbol, zone_id, round(score, 5) as score, tier, cast(n_heavy as bigint) as n_heavy, n_categories, round(width_pct, 6) as width_pct, round(score / nullif(raw, 0), 6) as density from zones")
def zone_score(spark, sf_dir):
    z = zones_of(spark, sf_dir)
    return z.select("symbol", F.col("zone_id").cast("long").alias("zone_id"), r6("score", "score", 5), "tier", F.col("n_heavy").cast("long").alias("n_heavy"), "n_categories", r6("width_pct", "width_pct"), r6(F.try_divide("score", F.nullif(F.col("raw"), F.lit(0.0))), "density"))


@query(f"{ZONE_SQL} select symbol, zone_id, is_valid, rejection_reason, is_valid and zone_id = 0 as is_best from zones")
def zone_validity(spark, sf_dir):
    z = zones_of(spark, sf_dir)
    return z.select("symbol", F.col("zone_id").cast("long").alias("zone_id"), "is_valid", "rejection_reason", "is_best")


@query(f"""{ZONE_SQL}, g as (select z.*, s.atr, cast(case when z.spot <= 25 then 0.5 when z.spot <= 100 then 1 when z.spot <= 250 then 2.5 else 5 end as double) as grid from zones z join spots s using (symbol) where zone_id = 0)
select symbol, is_valid, round(score, 5) as score, grid, floor(greatest(upper, spot - atr) / grid + 0.5) * grid as strike_aggressive, floor(center / grid + 0.5) * grid as strike_natural, floor((lower - atr) / grid + 0.5) * grid as strike_conservative from g""")
def best_zone_strikes(spark, sf_dir):
    """Strikes of each symbol's first zone."""
    first = zones_of(spark, sf_dir).filter("zone_id = 0")
    made = K.strikes(*[F.col(c) for c in ("lower", "upper", "center", "spot", "atr")], F.lit("USD"))
    return first.select("symbol", "is_valid", r6("score", "score", 5), K.grid(F.col("spot"), F.lit("USD")).alias("grid"), *[c.alias(n) for n, c in made.items()])


@query("""select o_orderkey, currency, spot, cast(case when currency in ('USD', 'EUR', 'CHF', 'GBP') then case when spot <= 25 then 0.5 when spot <= 100 then 1 when spot <= 250 then 2.5 else 5 end
    when currency = 'GBp' then case when spot <= 2500 then 50 when spot <= 10000 then 100 when spot <= 25000 then 250 else 500 end when spot <= 0 then 0.01 else round_even(spot * 0.01 / pow(10, floor(log10(spot * 0.01))), 0) * pow(10, floor(log10(spot * 0.01))) end as double) as grid
from (select o_orderkey, (['USD', 'EUR', 'CHF', 'GBP', 'GBp', 'JPY', 'SEK'])[o_orderkey % 7 + 1] as currency, case when o_orderkey % 7 < 4 then o_totalprice / 1000 when o_orderkey % 35 = 5 then 0 else round(o_totalprice / 10) end as spot from orders)""")
def strike_grid(spark, sf_dir):
    """Orders as prices in seven currencies, some of them zero."""
    key = F.col("o_orderkey")
    currency = F.element_at(F.lit(["USD", "EUR", "CHF", "GBP", "GBp", "JPY", "SEK"]), (key % 7 + 1).cast("int"))
    spot = F.when(key % 7 < 4, F.col("o_totalprice") / 1000).when(key % 35 == 5, 0.0).otherwise(F.round(F.col("o_totalprice") / 10))
    rows = tape.read(spark, sf_dir, "orders").select("o_orderkey", currency.alias("currency"), spot.alias("spot"))
    return rows.withColumn("grid", K.grid(F.col("spot"), F.col("currency")))


#: Bars between the days of the queries over many days.
STEP = 63
_sep = ",\nweekly as ("
#: The same SQL over every series cut at every STEP-th bar: symbol@bar is a series of its own.
AS_OF_SQL = ZONE_SQL.replace("\nbars as (", "\nall_bars as (").replace(
    _sep, f""",
bars as (select a.symbol || '@' || d.rn as symbol, a.date, a.open, a.high, a.low, a.close, a.volume, a.rn from all_bars a join all_bars d on d.symbol = a.symbol and a.rn <= d.rn where d.rn % {STEP} = {STEP - 1}){_sep}"""
).replace(EARNINGS_SQL, "earnings as (select symbol, cast(d as date) as date from (select symbol, max(date) as today from bars group by symbol), (values " + ", ".join(f"('{d}')" for d in EARNINGS) + ") as e(d) where cast(d as date) <= today)")


def zones_on(spark, sf_dir):
    bars, weeks, found = inputs(spark, sf_dir)
    return A.zones(bars, weeks, found, STEP, earnings(spark, sf_dir))


@query(f"{AS_OF_SQL} select split_part(symbol, '@', 1) as symbol, cast(split_part(symbol, '@', 2) as integer) as at, zone_id, round(lower, 5) as lower, round(upper, 5) as upper, round(score, 5) as score, tier, is_valid, elements from zones")
def zones_as_of(spark, sf_dir):
    """Zones as of every STEP-th bar of all series, in one pass."""
    z = zones_on(spark, sf_dir)
    return z.select("symbol", "at", F.col("zone_id").cast("long").alias("zone_id"), r6("lower", "lower", 5), r6("upper", "upper", 5), r6("score", "score", 5), "tier", "is_valid", F.array_join("elements", ",").alias("elements"))


OUTCOME_SQL = f"""{AS_OF_SQL},
proposals as (select split_part(z.symbol, '@', 1) as symbol, cast(split_part(z.symbol, '@', 2) as integer) as at, z.tier, z.spot, z.lower, s.atr from zones z join spots s using (symbol) where z.is_valid and z.zone_id = 0),
priced as (select *, cast(case when spot <= 25 then 0.5 when spot <= 100 then 1 when spot <= 250 then 2.5 else 5 end as double) as grid from proposals),
outcomes as (select p.symbol, p.at, p.tier, floor((p.lower - p.atr) / p.grid + 0.5) * p.grid as strike, min(b.low) as lowest
  from priced p join all_bars b on b.symbol = p.symbol and b.rn > p.at and b.rn <= p.at + {A.HORIZON} group by p.symbol, p.at, p.tier, p.lower, p.atr, p.grid having count(*) = {A.HORIZON})"""


@query(f"{OUTCOME_SQL} select tier, count(*) as n, count_if(lowest >= strike)::bigint as n_held, round(count_if(lowest >= strike) / count(*), 6) as rate from outcomes group by rollup (tier) having count(*) > 0")
def zone_hold_rate(spark, sf_dir):
    """How many of the best zones of all days held for three weeks, by tier and in all."""
    bars, _, _ = inputs(spark, sf_dir)
    return A.hold_rate(A.outcomes(zones_on(spark, sf_dir), bars)).select("tier", "n", "n_held", r6("rate", "rate"))


DAILY_SQL = f"""days_of as (select symbol, rn, date, close as spot, min(low) over w as bottom, (max(high) over w - min(low) over w) / 50 as width from bars window w as (partition by symbol order by rn rows between 251 preceding and current row)),
dealt as (select d.symbol, d.rn, d.date, d.bottom, d.width, k as bucket,
    sum(case when high - low <= 0 then case when greatest(0, least(49, floor((close - bottom) / width))) = k then volume else 0 end
      else greatest(least(high, bottom + k * width + width) - greatest(low, bottom + k * width), 0) / (high - low) * volume end) as volume
  from days_of d join bars b on b.symbol = d.symbol and b.rn between d.rn - 251 and d.rn, (select unnest(range(50)) as k) where width > 0 and d.rn >= 251 group by all),
nodes as (select p.*, bucket - row_number() over (partition by symbol, p.rn order by bucket) as run from dealt p join (select symbol, rn, quantile_cont(volume, 0.8) as edge from dealt group by symbol, rn) e using (symbol, rn) where volume >= edge),
islands as (select symbol, rn, date, min(bucket) as a, max(bucket) as b, (min(bottom + bucket * width) + max(bottom + (bucket + 1) * width)) / 2 as price from nodes group by symbol, rn, date, run)"""


@query(f"{WITH}, {DAILY_SQL} select symbol, date, count(*) as n_nodes, string_agg(a || '-' || b, ',' order by a) as nodes, round(min(price), 4) as lowest from islands group by symbol, date")
def volume_nodes_daily(spark, sf_dir):
    """The volume nodes of every day of all series."""
    daily = V.sliding(S.numbered(tape.bars(spark, sf_dir)))
    price = F.transform("nodes", lambda n: (n["low"] + n["high"]) / 2)
    return daily.select("symbol", "date", F.size("nodes").cast("long").alias("n_nodes"), F.array_join(F.transform("nodes", lambda n: F.concat_ws("-", n["first"].cast("string"), n["last"].cast("string"))), ",").alias("nodes"), r6(F.array_min(price), "lowest", 4))

"""Queries over patterns, regimes, triggers and classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confluence import config as C
from confluence.functions import series as S
from confluence.operators import detectors as D
from confluence.operators import regime as R
from confluence.operators import zones as Z
from confluence.plans.catalog import query
from confluence.plans.q_levels import EARNINGS_SQL, PIVOT_SQL, ZONE_SQL, earnings, inputs, zones_of
from confluence.plans.q_series import HMA_SQL, SMA_SQL, WITH, r6
from confluence.sources import tape

DOUBLE_SQL = """db_pairs as (select a.symbol, a.rn as l1_rn, b.rn as l2_rn, a.price as l1, b.price as l2, s.spot from pivots a join pivots b using (symbol) join spots s using (symbol)
  where a.kind = 'low' and b.kind = 'low' and a.rn >= s.top - 180 and b.rn >= s.top - 180 and b.rn - a.rn between 15 and 80 and abs(b.price - a.price) / a.price < 0.03),
db_neck as (select p.*, coalesce((select max(price) from pivots h where h.symbol = p.symbol and h.kind = 'high' and h.rn > p.l1_rn and h.rn < p.l2_rn), (select max(high) from bars b where b.symbol = p.symbol and b.rn between p.l1_rn and p.l2_rn)) as neckline from db_pairs p),
db as (select symbol, l1_rn, l2_rn, l1, l2, neckline, (neckline - least(l1, l2)) / least(l1, l2) as bounce, spot > neckline as confirmed from db_neck where (neckline - least(l1, l2)) / least(l1, l2) >= 0.08 qualify row_number() over (partition by symbol order by l2_rn desc, l1_rn) = 1)"""


@query(f"{PIVOT_SQL}, {DOUBLE_SQL} select symbol, l1_rn, l2_rn, l1, l2, neckline, round(bounce, 6) as bounce, confirmed from db")
def double_bottom(spark, sf_dir):
    bars, _, found = inputs(spark, sf_dir)
    long = lambda c: F.col(c).cast("long").alias(c)
    return D.double_bottom(bars, found).select("symbol", long("l1_rn"), long("l2_rn"), "l1", "l2", "neckline", r6("bounce", "bounce"), "confirmed")


def capitulation_sql(name, range_atr, volume, close, drop):
    return f"""{name}_flags as (select *, avg(volume) over (partition by symbol order by rn rows between 20 preceding and 1 preceding) as calm, lag(close, 1) over (partition by symbol order by rn) / lag(close, 11) over (partition by symbol order by rn) - 1 as before from full_bars),
{name}_climax as (select symbol, rn, close, low from {name}_flags where rn between top - 60 and top - 10 and rn >= 20 and high - low > {range_atr} * atr and volume > {volume} * calm and (close - low) / nullif(high - low, 0) > {close} and before < {drop}),
{name} as (select c.symbol, c.rn as climax_rn, c.close as climax_close, min(b.rn) as reclaim_rn from {name}_climax c join bars b on b.symbol = c.symbol and b.rn > c.rn and b.rn <= c.rn + 10 and b.close > c.close
  where not exists (select 1 from bars x where x.symbol = c.symbol and x.rn > c.rn and x.rn <= b.rn and x.low <= c.low) group by c.symbol, c.rn, c.close qualify row_number() over (partition by c.symbol order by min(b.rn) desc, c.rn desc) = 1)"""


#: The tape is calm, so this query lowers the thresholds; the classification uses the usual ones.
MILD = {"range_atr": 0.9, "volume": 0.9, "close": 0.2, "drop": 0.0}


@query(f"{PIVOT_SQL}, {capitulation_sql('cap', **MILD)} select symbol, climax_rn, climax_close, reclaim_rn from cap")
def capitulation(spark, sf_dir):
    bars, _, _ = inputs(spark, sf_dir)
    return D.capitulation(bars, **MILD).select("symbol", F.col("climax_rn").cast("long").alias("climax_rn"), "climax_close", F.col("reclaim_rn").cast("long").alias("reclaim_rn"))


FLIP_SQL = f"""{HMA_SQL}, slopes as (select symbol, rn, close, hma, (hma - lag(hma) over (partition by symbol order by rn)) / lag(hma) over (partition by symbol order by rn) as slope, count(*) over (partition by symbol) as n from hmas),
turns as (select *, lag(slope) over (partition by symbol order by rn) < 0 and slope > 0.001 as turn from slopes where n >= 100),
flips as (select symbol, max(rn) - max(case when turn then rn end) as weeks_since, arg_max(close, rn) > arg_max(hma, rn) as close_above, max(rn) - max(case when turn then rn end) < 3 as valid from turns group by symbol having max(case when turn then rn end) is not null)"""


@query(f"{WITH}, {FLIP_SQL} select * from flips")
def hma_flip(spark, sf_dir):
    out = D.hma_flip(S.numbered(S.weekly(tape.bars(spark, sf_dir))))
    return out.select("symbol", F.col("weeks_since").cast("long").alias("weeks_since"), "close_above", "valid")


DIVERGENCE_SQL = """dt_two as (select p.symbol, p.price, b.rsi, row_number() over (partition by p.symbol order by p.rn desc) as back from pivots p join full_bars b using (symbol, rn) where kind = 'low' and p.date >= (select max(date) from bars x where x.symbol = p.symbol) - 60),
dt as (select b.symbol, a.price as p1, b.price as p2, a.rsi as rsi1, b.rsi as rsi2 from dt_two b join dt_two a on a.symbol = b.symbol and a.back = 2 where b.back = 1 and b.price < a.price and b.rsi > a.rsi and b.rsi < 45)"""


@query(f"{PIVOT_SQL}, {DIVERGENCE_SQL} select symbol, p1, p2, round(rsi1, 5) as rsi1, round(rsi2, 5) as rsi2 from dt")
def divergence_trigger(spark, sf_dir):
    bars, _, found = inputs(spark, sf_dir)
    return R.divergence(bars, found).select("symbol", "p1", "p2", r6("rsi1", "rsi1", 5), r6("rsi2", "rsi2", 5))


RANGE_SQL = """rng as (select symbol, max(high) as top_price, min(low) as floor_price, count(*) as n, any_value(spot) as spot from full_bars where rn > top - 60 group by symbol),
rf as (select symbol, (spot - floor_price) / nullif(top_price - floor_price, 0) as position from rng where n >= 60 and spot < floor_price + 0.33 * (top_price - floor_price))"""


@query(f"{PIVOT_SQL}, {RANGE_SQL} select symbol, round(position, 6) as position from rf")
def range_floor(spark, sf_dir):
    bars, _, _ = inputs(spark, sf_dir)
    return R.range_floor(bars).select("symbol", r6("position", "position"))


DIP_SQL = f"""{EARNINGS_SQL}, ev as (select e.symbol, max(e.date) as event from earnings e join (select symbol, max(date) as today from bars group by symbol) t using (symbol) where e.date <= today and e.date >= today - 60 group by e.symbol),
dip_all as (select symbol, event, (select arg_max(close, date) from bars b where b.symbol = ev.symbol and b.date < event) as before, (select list(close order by date) from bars b where b.symbol = ev.symbol and b.date > event)[2] as after from ev),
dip as (select symbol, event, after / before - 1 as change from dip_all where after / before - 1 <= -0.05)"""


@query(f"{WITH}, {DIP_SQL.replace('<= -0.05', '<= 0.05')} select symbol, event, round(change, 6) as change from dip where symbol >= 'F'")
def post_earnings_dip(spark, sf_dir):
    """With a mild threshold, as the tape has few dips; the symbols before F are taken to have earnings ahead."""
    bars, _, _ = inputs(spark, sf_dir)
    ahead = bars.select("symbol").filter("symbol < 'F'")
    return R.post_earnings_dip(bars, earnings(spark, sf_dir), dip=0.05, upcoming=ahead).select("symbol", "event", r6("change", "change"))


REGIME_SQL = f"""{FLIP_SQL}, wk as (select symbol, {SMA_SQL(50)} as a, {SMA_SQL(200)} as b from weeks qualify row_number() over (partition by symbol order by rn desc) = 1),
regimes as (select w.symbol, case when coalesce(f.valid and f.close_above, false) then 'reversal' when a is null or b is null then 'downtrend' when r.n >= 60 and abs(a - b) / b < 0.03 and (top_price - floor_price) / floor_price < 0.15 then 'lateral' when a > b then 'uptrend' else 'downtrend' end as regime
  from wk w join rng r using (symbol) left join flips f using (symbol))"""


@query(f"{PIVOT_SQL}, {RANGE_SQL}, {REGIME_SQL} select symbol, regime from regimes")
def regime(spark, sf_dir):
    bars, weeks, _ = inputs(spark, sf_dir)
    return R.regimes(bars, weeks, D.hma_flip(weeks))


def facts(spark, sf_dir, today=None):
    """symbol, regime and a boolean per trigger, as of a day."""
    bars, weeks, found = inputs(spark, sf_dir, today)
    flips = D.hma_flip(weeks)
    events = earnings(spark, sf_dir, today)
    zone = Z.best(zones_of(spark, sf_dir, today))
    hit = lambda df, name: df.select("symbol", (name if isinstance(name, Column) else F.lit(name)).alias("trigger"))
    double = F.when(F.col("confirmed"), "double_bottom_confirmed").otherwise("double_bottom_unconfirmed")
    hits = reduce(DataFrame.unionByName, (
        hit(zone.filter((F.col("score") >= C.MIN_SCORE) & (F.col("distance") <= C.MAX_DISTANCE)), "pullback_in_uptrend"), hit(D.double_bottom(bars, found), double),
        hit(D.capitulation(bars), "capitulation_reclaim"), hit(flips.filter("valid and close_above"), "hma_weekly_flip"), hit(R.range_floor(bars), "range_floor"),
        hit(R.post_earnings_dip(bars, events), "post_earnings_dip"), hit(R.divergence(bars, found), "bullish_divergence"),
    ))
    wide = hits.groupBy("symbol").agg(*[F.max(F.col("trigger") == name).alias(name) for name, _, _ in C.TRIGGERS])
    return R.regimes(bars, weeks, flips).join(wide, "symbol", "left")


_hits = " union all ".join(
    f"select symbol, {i} as ord, {w} as weight, '{n}' as name from {src} join regimes using (symbol) where regime in ({', '.join(repr(x) for x in fit)})"
    for i, ((n, w, fit), src) in enumerate(zip(C.TRIGGERS, (
        "(select symbol from zones where is_valid and zone_id = 0 and score >= 5 and distance <= 0.10)", "(select symbol from db where confirmed)", "(select symbol from db where not confirmed)",
        "(select symbol from cap)", "(select symbol from flips where valid and close_above)", "(select symbol from rf)", "(select symbol from dip)", "(select symbol from dt)",
    )))
)
CLASSIFY_SQL = f"""{ZONE_SQL}, {DOUBLE_SQL}, {capitulation_sql('cap', C.CAPITULATION_RANGE, C.CAPITULATION_VOLUME, C.CAPITULATION_CLOSE, C.CAPITULATION_DROP)}, {DIVERGENCE_SQL}, {RANGE_SQL}, {REGIME_SQL}, {DIP_SQL.split(', ev as', 1)[1].join(['ev as', ''])},
hits as ({_hits}),
classes as (select r.symbol, r.regime, coalesce((select string_agg(name, '|' order by weight desc, ord) from hits h where h.symbol = r.symbol), '') as triggers, (select name from hits h where h.symbol = r.symbol and weight > 0 order by weight desc, ord limit 1) as primary_trigger from regimes r)"""


@query(f"{CLASSIFY_SQL} select symbol, regime, triggers, primary_trigger from classes")
def classify(spark, sf_dir):
    return R.classified(facts(spark, sf_dir)).select("symbol", "regime", "triggers", "primary_trigger")


#: A day before the tape's end, for queries as of it.
PAST = "1998-11-30"


def past_sql(sql: str, today: str = PAST) -> str:
    """A query over what was known on a day: its bars and earnings end there."""
    cut = sql.replace("from closes),\nweekly as", f"from closes where date <= date '{today}'),\nweekly as")
    assert cut != sql
    return cut.replace(f"{EARNINGS_SQL[:-1]}", f"{EARNINGS_SQL[:-1]} where d <= '{today}'")


@query(f"{past_sql(CLASSIFY_SQL)} select c.symbol, regime, triggers, primary_trigger, round(z.score, 5) as score, round(z.distance, 6) as distance from classes c left join zones z on z.symbol = c.symbol and z.zone_id = 0")
def classify_as_of(spark, sf_dir):
    first = zones_of(spark, sf_dir, PAST).filter("zone_id = 0").select("symbol", r6("score", "score", 5), r6("distance", "distance"))
    return R.classified(facts(spark, sf_dir, PAST)).select("symbol", "regime", "triggers", "primary_trigger").join(first, "symbol", "left")


@query(f"{past_sql(PIVOT_SQL)}, {DOUBLE_SQL} select symbol, l1_rn, l2_rn, l1, l2, neckline, round(bounce, 6) as bounce, confirmed from db")
def double_bottom_as_of(spark, sf_dir):
    bars, _, found = inputs(spark, sf_dir, PAST)
    long = lambda c: F.col(c).cast("long").alias(c)
    return D.double_bottom(bars, found).select("symbol", long("l1_rn"), long("l2_rn"), "l1", "l2", "neckline", r6("bounce", "bounce"), "confirmed")


_numbers = {
    "double_bottom_confirmed": ("db where confirmed", ("l1", "l2", "neckline", "bounce")), "double_bottom_unconfirmed": ("db where not confirmed", ("l1", "l2", "neckline", "bounce")),
    "capitulation_reclaim": ("cap", ("climax_rn", "climax_close", "reclaim_rn")), "range_floor": ("rf", ("position",)), "post_earnings_dip": ("dip", ("change",)), "bullish_divergence": ("dt", ("p1", "p2", "rsi1", "rsi2")),
}
FACT_SQL = " union all ".join(
    f"select symbol, '{name}' as trigger, '{c}' as fact, round(cast({c} as double), 5) as value from (select * from {source}) join regimes using (symbol) where regime in ({', '.join(map(repr, fit))})"
    for name, _, fit in C.TRIGGERS if name in _numbers for source, columns in (_numbers[name],) for c in columns
)


@query(f"{CLASSIFY_SQL} {FACT_SQL}")
def trigger_facts(spark, sf_dir):
    bars, weeks, found = inputs(spark, sf_dir)
    double = D.double_bottom(bars, found).withColumn("trigger", F.when(F.col("confirmed"), "double_bottom_confirmed").otherwise("double_bottom_unconfirmed"))
    named = lambda df, name: df.withColumn("trigger", F.lit(name)).select("symbol", "trigger", *_numbers[name][1])
    own = [
        double.select("symbol", "trigger", *_numbers["double_bottom_confirmed"][1]), named(D.capitulation(bars), "capitulation_reclaim"), named(R.range_floor(bars), "range_floor"),
        named(R.post_earnings_dip(bars, earnings(spark, sf_dir)), "post_earnings_dip"), named(R.divergence(bars, found), "bullish_divergence"),
    ]
    return R.trigger_facts(R.regimes(bars, weeks, D.hma_flip(weeks)), own).withColumn("value", F.round("value", 5))


LABEL_SQL = f"""case regime {' '.join(f"when '{k}' then '{v}'" for k, v in R.REGIME_LABELS.items())} end || ': ' || coalesce(case primary_trigger {' '.join(f"when '{k}' then '{v}'" for k, v in R.TRIGGER_LABELS.items())} end
    || case when triggers like '%bullish_divergence%' then ' + divergencia' else '' end, 'sin trigger')"""


@query(f"""{CLASSIFY_SQL} select symbol, primary_trigger, case {' '.join(f"when primary_trigger = '{k}' then '{v}'" for k, v in R.LEGACY.items())} end as legacy,
  {LABEL_SQL} as label from classes""")
def primary_trigger(spark, sf_dir):
    return R.classified(facts(spark, sf_dir)).select("symbol", "primary_trigger", "legacy", "label")


LEGACY_SQL = f"""{EARNINGS_SQL}, lg_week as (select symbol, {SMA_SQL(50)} as a, {SMA_SQL(200)} as b from weeks qualify row_number() over (partition by symbol order by rn desc) = 1),
lg_last as (select symbol, spot, top, rsi, date as today, (select max(close) from bars p where p.symbol = f.symbol and p.rn between f.rn - 5 and f.rn - 1) as peak from full_bars f where rn = top),
lg_span as (select symbol, min(close) as low, max(close) as high, avg(close) as mean, count(*) as n from full_bars where rn > top - 60 group by symbol),
lg_ev as (select l.symbol, (select max(e.date) from earnings e where e.symbol = l.symbol and e.date <= l.today and e.date >= l.today - 60) as event from lg_last l),
lg_near as (select symbol, (select arg_max(close, date) from bars b where b.symbol = v.symbol and b.date < v.event) as before, (select arg_min(close, date) from bars b where b.symbol = v.symbol and b.date > v.event) as after from lg_ev v),
lg as (select w.symbol, a > b and spot > b as t1, coalesce(top >= 5 and spot / peak - 1 <= -0.10 and (a > b or abs(a - b) / b <= 0.03), false) as t2,
  coalesce(abs(a - b) / b <= 0.03 and n >= 60 and (high - low) / mean <= 0.15 and spot < low + 0.3 * (high - low), false) as t3, coalesce(after / before - 1 <= -0.05 and a >= b * 0.97 and rsi < 55, false) as t4
  from lg_week w join lg_last using (symbol) join lg_span using (symbol) join lg_near using (symbol) where b > 0 and a is not null)"""


@query(f"""{PIVOT_SQL}, {LEGACY_SQL} select symbol, t1, t2, t3, t4, case when t1 then 'T1' when t2 then 'T2' when t4 then 'T4' when t3 then 'T3' end as kind,
  concat_ws(',', case when t2 and t1 then 'T2' end, case when t3 and (t1 or t2 or t4) then 'T3' end, case when t4 and (t1 or t2) then 'T4' end) as others from lg""")
def legacy_classify(spark, sf_dir):
    from confluence.operators import legacy

    bars, weeks, _ = inputs(spark, sf_dir)
    return legacy.types(bars, weeks, earnings(spark, sf_dir))

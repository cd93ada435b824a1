"""Queries over series: bars, averages, oscillators, volatility."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from confluence import config as C
from confluence.functions import rolling
from confluence.functions import series as S
from confluence.operators import asof
from confluence.plans.catalog import query
from confluence.sources import tape

WITH = f"with recursive {tape.SQL}"


def r6(c, name, digits=6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits).alias(name)


def bars_of(spark, sf_dir):
    return S.numbered(tape.bars(spark, sf_dir))


def weeks_of(spark, sf_dir):
    return S.numbered(S.weekly(tape.bars(spark, sf_dir)))


def ewm_sql(name: str, source: str, x: str, alpha: str) -> str:
    """A recursive CTE that smooths column x of ``source`` (symbol, rn) bar by bar."""
    return f"""{name} as (
  select symbol, rn, cast({x} as double) as y from {source} where rn = 0
  union all
  select b.symbol, b.rn, (1 - {alpha}) * e.y + {alpha} * b.{x} from {name} e join {source} b on b.symbol = e.symbol and b.rn = e.rn + 1)"""


RSI_SQL = lambda source, p: f"""{p}moves as (select symbol, date, rn, close, greatest(coalesce(close - lag(close) over w, 0), 0) as up, greatest(-coalesce(close - lag(close) over w, 0), 0) as down from {source} window w as (partition by symbol order by rn)),
{ewm_sql(p + 'ups', p + 'moves', 'up', '(1.0::double / 14)')}, {ewm_sql(p + 'downs', p + 'moves', 'down', '(1.0::double / 14)')},
{p}rsi as (select m.symbol, m.date, m.rn, m.close, case when d.y = 0 then case when u.y > 0 then 100.0 else 50.0 end else 100.0 - 100.0 / (1.0 + u.y / d.y) end as rsi
  from {p}moves m join {p}ups u using (symbol, rn) join {p}downs d using (symbol, rn))"""  # noqa: E731
MACD_SQL = f"""{ewm_sql('fast', 'bars', 'close', '(2.0::double / 13)')}, {ewm_sql('slow', 'bars', 'close', '(2.0::double / 27)')},
lines as (select symbol, rn, f.y - s.y as line from fast f join slow s using (symbol, rn)), {ewm_sql('signal', 'lines', 'line', '(2.0::double / 10)')},
macd as (select b.symbol, b.date, b.rn, l.line - s.y as hist from bars b join lines l using (symbol, rn) join signal s using (symbol, rn))"""
ATR_SQL = f"""trs as (select symbol, date, rn, greatest(high - low, coalesce(abs(high - lag(close) over w), 0), coalesce(abs(low - lag(close) over w), 0)) as tr from bars window w as (partition by symbol order by rn)),
{ewm_sql('atrs', 'trs', 'tr', '(1.0::double / 14)')}"""
SMA_SQL = lambda n, x="close", w="": f"case when count({x}) over (partition by symbol order by rn rows between {n - 1} preceding and current row) = {n} then avg({x}) over (partition by symbol order by rn rows between {n - 1} preceding and current row) end"


def wma_sql(x: str, n: int) -> str:
    """The weighted mean said by its definition: a sum of lags times weights."""
    parts = " + ".join(f"{n - k} * lag({x}, {k}) over (partition by symbol order by rn)" for k in range(n))
    return f"(({parts}) / {n * (n + 1) / 2.0})"


HMA_SQL = f"""raw as (select symbol, date, rn, close, 2 * {wma_sql('close', 25)} - {wma_sql('close', 50)} as raw from weeks),
hmas as (select symbol, date, rn, close, {wma_sql('raw', 7)} as hma from raw)"""


@query(f"{WITH} select symbol, date, open, high, low, close, volume from bars")
def tape_bars(spark, sf_dir):
    return tape.bars(spark, sf_dir)


@query(f"{WITH} select symbol, date, open, high, low, close, volume from weekly")
def weekly_bars(spark, sf_dir):
    return S.weekly(tape.bars(spark, sf_dir))


@query(f"{WITH} select symbol, max(date) as week_end, arg_max(close, date) as close, max(date) > (select max(date) from bars b where b.symbol = weekly.symbol) as unfinished from weekly group by symbol")
def weekly_bars_partial(spark, sf_dir):
    """The running week counts, labelled by a Friday that may lie ahead."""
    bars = tape.bars(spark, sf_dir)
    ends = bars.groupBy("symbol").agg(F.max("date").alias("last"))
    last = S.last_rows(S.weekly(bars))
    return last.join(ends, "symbol").select("symbol", F.col("date").alias("week_end"), "close", (F.col("date") > F.col("last")).alias("unfinished"))


@query(f"{WITH} select symbol, date, round({SMA_SQL(50)}, 8) as sma_50, round({SMA_SQL(200)}, 8) as sma_200 from bars")
def sma_daily(spark, sf_dir):
    return bars_of(spark, sf_dir).select("symbol", "date", r6(S.sma(F.col("close"), 50), "sma_50", 8), r6(S.sma(F.col("close"), 200), "sma_200", 8))


@query(f"{WITH} select symbol, date, round({SMA_SQL(50)}, 8) as sma_50, round({SMA_SQL(200)}, 8) as sma_200 from weeks")
def sma_weekly(spark, sf_dir):
    return weeks_of(spark, sf_dir).select("symbol", "date", r6(S.sma(F.col("close"), 50), "sma_50", 8), r6(S.sma(F.col("close"), 200), "sma_200", 8))


@query(f"{WITH}, {ewm_sql('e50', 'bars', 'close', '(2.0::double / 51)')}, {ewm_sql('e200', 'bars', 'close', '(2.0::double / 201)')} select b.symbol, b.date, round(e50.y, 5) as ema_50, round(e200.y, 5) as ema_200 from bars b join e50 using (symbol, rn) join e200 using (symbol, rn)")
def ema_daily(spark, sf_dir):
    return bars_of(spark, sf_dir).select("symbol", "date", r6(S.ema(F.col("close"), 50), "ema_50", 5), r6(S.ema(F.col("close"), 200), "ema_200", 5))


@query(f"{WITH}, {RSI_SQL('bars', '')} select symbol, date, round(rsi, 5) as rsi from rsi")
def rsi_daily(spark, sf_dir):
    return S.with_rsi(bars_of(spark, sf_dir)).select("symbol", "date", r6("rsi", "rsi", 5))


@query(f"{WITH}, {RSI_SQL('weeks', '')} select symbol, date, round(rsi, 5) as rsi from rsi")
def rsi_weekly(spark, sf_dir):
    return S.with_rsi(weeks_of(spark, sf_dir)).select("symbol", "date", r6("rsi", "rsi", 5))


@query(f"{WITH}, {MACD_SQL} select symbol, date, round(hist, 5) as macd_hist from macd")
def macd_hist(spark, sf_dir):
    return S.with_macd(bars_of(spark, sf_dir)).select("symbol", "date", r6("macd_hist", "macd_hist", 5))


@query(f"""{WITH}, {MACD_SQL}, past as (select *, lag(hist, 3) over (partition by symbol order by rn) as old from macd)
select symbol, date, case when old is null or abs(hist - old) / greatest(abs(old), 1e-9) < 0.05 then 'neutral'
  else case when hist > old then 'subiendo_' else 'bajando_' end || case when hist >= 0 then 'positivo' else 'negativo' end end as macd_state
from past qualify row_number() over (partition by symbol order by rn desc) = 1""")
def macd_state(spark, sf_dir):
    return S.last_rows(S.with_macd(bars_of(spark, sf_dir))).select("symbol", "date", "macd_state")


@query(f"{WITH}, {ATR_SQL} select b.symbol, b.date, round(a.y, 5) as atr from bars b join atrs a using (symbol, rn)")
def atr_14(spark, sf_dir):
    return S.with_atr(bars_of(spark, sf_dir)).select("symbol", "date", r6("atr", "atr", 5))


HV_SQL = "logs as (select symbol, date, rn, ln(close / lag(close) over (partition by symbol order by rn)) as r from bars), hvs as (select symbol, date, rn, case when count(r) over w = 20 then stddev_samp(r) over w * sqrt(252) end as hv from logs window w as (partition by symbol order by rn rows between 19 preceding and current row))"


@query(f"{WITH}, {HV_SQL} select symbol, date, round(hv, 6) as hv from hvs")
def hv20(spark, sf_dir):
    return S.with_hv(bars_of(spark, sf_dir)).select("symbol", "date", r6("hv", "hv"))


@query(f"""{WITH}, {HV_SQL}, recent as (select *, row_number() over (partition by symbol order by rn desc) as back, count(*) over (partition by symbol) as n from hvs)
select symbol, case when max(n) >= 272 then round(100.0 * sum(case when round(hv, 9) <= round(now, 9) then 1 else 0 end) / 252, 6) else 50.0 end as hv_percentile
from (select *, max(case when back = 1 then hv end) over (partition by symbol) as now from recent where back <= 252) group by symbol""")
def hv_percentile(spark, sf_dir):
    """The share of the last 252 volatilities up to today's; 50 where there are fewer than 272 bars."""
    whole = W.partitionBy("symbol")
    df = S.with_hv(bars_of(spark, sf_dir)).withColumns({"n": F.count("*").over(whole), "top": F.max("rn").over(whole)}).filter(F.col("rn") > F.col("top") - C.HV_WINDOW)
    now = F.max(F.when(F.col("rn") == F.col("top"), F.col("hv"))).over(whole)
    share = F.lit(100.0) * F.count_if(F.round("hv", 9) <= F.round("now", 9)) / C.HV_WINDOW
    return df.withColumn("now", now).groupBy("symbol").agg(F.when(F.max("n") >= C.HV_WINDOW + C.HV_LENGTH, F.round(share, 6)).otherwise(50.0).alias("hv_percentile"))


@query(f"{WITH} select symbol, date, round({wma_sql('close', 25)}, 5) as wma_25 from weeks")
def wma(spark, sf_dir):
    return weeks_of(spark, sf_dir).select("symbol", "date", r6(S.wma(F.col("close"), 25), "wma_25", 5))


@query(f"{WITH}, {HMA_SQL} select symbol, date, round(hma, 5) as hma from hmas")
def hma_weekly(spark, sf_dir):
    return S.with_hma(weeks_of(spark, sf_dir)).select("symbol", "date", r6("hma", "hma", 5))


@query(f"{WITH} select symbol, date as last_date, close as spot, n_bars from (select *, row_number() over (partition by symbol order by rn desc) as back, count(*) over (partition by symbol) as n_bars from bars) where back = 1")
def last_bar(spark, sf_dir):
    df = bars_of(spark, sf_dir).withColumn("n_bars", F.count("*").over(W.partitionBy("symbol")))
    return S.last_rows(df).select("symbol", F.col("date").alias("last_date"), F.col("close").alias("spot"), "n_bars")


@query(f"{WITH}, {RSI_SQL('bars', 'd')}, {RSI_SQL('weeks', 'w')} select d.symbol, round(d.rsi, 5) as rsi_daily, round(d.old, 5) as rsi_daily_3_ago, round(w.rsi, 5) as rsi_weekly, round(w.old, 5) as rsi_weekly_2_ago from (select symbol, rn, rsi, lag(rsi, 3) over (partition by symbol order by rn) as old from drsi qualify row_number() over (partition by symbol order by rn desc) = 1) d join (select symbol, rn, rsi, lag(rsi, 2) over (partition by symbol order by rn) as old from wrsi qualify row_number() over (partition by symbol order by rn desc) = 1) w on w.symbol = d.symbol")
def lag_n_values(spark, sf_dir):
    bars = tape.bars(spark, sf_dir)
    daily = S.with_rsi(S.numbered(bars), name="rsi_daily").withColumn("rsi_daily_3_ago", F.lag("rsi_daily", C.RSI_DAILY_LOOKBACK).over(S.by()))
    week = S.with_rsi(S.numbered(S.weekly(bars)), name="rsi_weekly").withColumn("rsi_weekly_2_ago", F.lag("rsi_weekly", C.RSI_WEEKLY_LOOKBACK).over(S.by()))
    a = S.last_rows(daily).select("symbol", r6("rsi_daily", "rsi_daily", 5), r6("rsi_daily_3_ago", "rsi_daily_3_ago", 5))
    return a.join(S.last_rows(week).select("symbol", r6("rsi_weekly", "rsi_weekly", 5), r6("rsi_weekly_2_ago", "rsi_weekly_2_ago", 5)), "symbol")


@query(f"{WITH} select symbol, date, round(close / max(close) over (partition by symbol order by rn rows between 5 preceding and 1 preceding) - 1, 6) as drop_5d from bars")
def drop_5d(spark, sf_dir):
    past = F.max("close").over(S.by().rowsBetween(-5, -1))
    return bars_of(spark, sf_dir).select("symbol", "date", r6(F.col("close") / past - 1, "drop_5d"))


@query(f"""{WITH}, s as (select symbol, date, close, {SMA_SQL(50)} as sma_50d, {SMA_SQL(200)} as sma_200d, rn from bars),
s50 as (select symbol, date, {SMA_SQL(50)} as sma_50w from weeks), j as (select s.*, w.sma_50w from s asof left join (select * from s50 where sma_50w is not null) w on s.symbol = w.symbol and s.date >= w.date)
select symbol, date, close, round(sma_50d, 8) as sma_50d, round(sma_200d, 8) as sma_200d, round(sma_50w, 8) as sma_50w from j where date >= (select max(date) from bars b where b.symbol = j.symbol) - interval 6 month""")
def sma_series_chart(spark, sf_dir):
    """The chart's payload: averages over the full history, weekly ones carried forward, cut to six months last."""
    bars = tape.bars(spark, sf_dir)
    daily = S.numbered(bars).select("symbol", "date", "close", S.sma(F.col("close"), 50).alias("sma_50d"), S.sma(F.col("close"), 200).alias("sma_200d"))
    week = S.numbered(S.weekly(bars)).select("symbol", "date", S.sma(F.col("close"), 50).alias("sma_50w"))
    both = daily.unionByName(week.filter("sma_50w is not null"), allowMissingColumns=True)
    # a week's label is its Friday, so it counts from that day on
    order = W.partitionBy("symbol").orderBy("date", F.col("close").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    filled = both.withColumn("sma_50w", F.last("sma_50w", ignorenulls=True).over(order)).filter("close is not null")
    newest = F.max("date").over(W.partitionBy("symbol"))
    kept = filled.withColumn("newest", newest).filter(F.col("date") >= F.add_months("newest", -6))
    return kept.select("symbol", "date", "close", r6("sma_50d", "sma_50d", 8), r6("sma_200d", "sma_200d", 8), r6("sma_50w", "sma_50w", 8))


@query(f"""{WITH}, {HV_SQL}, rounded as (select symbol, date, rn, round(hv, 9) as hv from hvs)
select a.symbol, a.date, case when a.rn >= 271 then round(100.0 * count_if(b.hv <= a.hv) / 252, 6) else 50.0 end as hv_percentile
from rounded a join rounded b on b.symbol = a.symbol and b.rn between a.rn - 251 and a.rn group by a.symbol, a.date, a.rn""")
def hv_percentile_daily(spark, sf_dir):
    """The volatility percentile as of every day; 50 before there are 272 bars."""
    hv = S.with_hv(bars_of(spark, sf_dir)).withColumn("hv", F.round("hv", 9))
    share = F.round(F.lit(100.0) * F.col("share"), 6)
    return rolling.order_statistics(hv, "hv", C.HV_WINDOW).select("symbol", "date", F.when(F.col("rn") >= C.HV_WINDOW + C.HV_LENGTH - 1, share).otherwise(50.0).alias("hv_percentile"))


@query(f"{WITH} select symbol, date, round(quantile_cont(volume, 0.8) over w, 6) as volume_80, round(cast(volume as double) / quantile_cont(volume, 0.8) over w, 6) as ratio from bars window w as (partition by symbol order by rn rows between 251 preceding and current row)")
def volume_percentile_daily(spark, sf_dir):
    """The 80th percentile of a year's volumes as of every day, and the day's volume against it."""
    found = rolling.order_statistics(bars_of(spark, sf_dir), "volume", C.HV_WINDOW)
    both = found.join(tape.bars(spark, sf_dir).select("symbol", "date", "volume"), ["symbol", "date"])
    return both.select("symbol", "date", r6("percentile", "volume_80"), r6(F.col("volume") / F.col("percentile"), "ratio"))


@query(f"""{WITH}, s50 as (select symbol, date as week, close as week_close, {SMA_SQL(50)} as sma_50w from weeks)
select b.symbol, b.date, b.close, w.week, w.week_close, round(w.sma_50w, 8) as sma_50w from bars b asof left join s50 w on w.symbol = b.symbol and b.date >= w.week""")
def weekly_on_daily(spark, sf_dir):
    """Every bar with the newest week that had ended by then."""
    bars = tape.bars(spark, sf_dir)
    week = S.numbered(S.weekly(bars)).select("symbol", "date", F.col("date").alias("week"), F.col("close").alias("week_close"), S.sma(F.col("close"), 50).alias("sma_50w"))
    met = asof.join(bars.select("symbol", "date", "close"), week, "symbol", "date", span=512)
    return met.select("symbol", "date", "close", "week", "week_close", r6("sma_50w", "sma_50w", 8))


@query(f"""{WITH}, sales as (select p_type as symbol, l_orderkey, l_linenumber, cast(l_shipdate as date) as date from lineitem join part on l_partkey = p_partkey)
select s.l_orderkey, s.l_linenumber, s.symbol, s.date, b.date as bar, b.close as close_before from sales s asof left join bars b on b.symbol = s.symbol and s.date > b.date""")
def price_before_shipment(spark, sf_dir):
    """Each order line with the last close before its own day."""
    parts = tape.read(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("symbol"))
    lines = tape.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").cast("date").alias("date"))
    sales = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "symbol", "date")
    bars = tape.bars(spark, sf_dir).select("symbol", "date", F.col("date").alias("bar"), F.col("close").alias("close_before"))
    return asof.join(sales, bars, "symbol", "date", span=365, exact=False)

"""Queries over bars, ticks and events, each with its SQL twin where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import garch as G
from ..operators import indicators as I
from ..operators import ledger as L
from ..operators import quality as Q
from ..operators import strategy as S
from ..scale import ranked
from ..session import materialize, work_dir
from ..sources.tables import table
from .machines import book_sql, machine_sql

QUERIES: dict = {}
SQL: dict[str, str] = {}
BAR_S = 900
WIDTH, LAG = 12, 6
KEY = ["series_id"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r(c, n: int = 9):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, n)


def rounded(df: DataFrame, *names: str, n: int = 9) -> DataFrame:
    return df.withColumns({c: r(c, n) for c in names})


# --- carriers ---------------------------------------------------------------------------------------------------------


def event_ticks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("px"), B.number_in(F.col("props")).alias("vol"))


_TICKS = r"""ticks as (select event_type as symbol, ts, event_id as seq, value as px, try_cast(regexp_extract(props, '([-+]?\d*\.?\d+)', 1) as double) as vol from events)"""
_TBARS = """tbars as (select symbol, time_bucket(interval 15 minutes, ts) as bts, arg_min(px, (ts, seq)) as open, max(px) as high, min(px) as low, arg_max(px, (ts, seq)) as close, sum(vol) as vol_sum, count(*) as tick_count
  from ticks where ts is not null and px is not null group by all)"""


def numbered(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Give rows their 0-based position by time within their key."""
    x = ranked(df.withColumn("_day", F.to_date(ts)), keys, "_day", [ts])
    return x.withColumnRenamed("_rank", "bar_idx").drop("_day")


def clean_bars(spark: SparkSession, d: str) -> DataFrame:
    """One row per series and time (the last sent), numbered by time."""
    b = Q.keep_last(table(spark, d, "bars").drop("loaded_at"), ["series_id", "time"], ["bar_id"])
    return numbered(b.withColumnRenamed("time", "ts"), KEY)


def good_bars(spark: SparkSession, d: str) -> DataFrame:
    """The same without faulty bars and prices at or below zero, numbered anew."""
    b = Q.keep_last(table(spark, d, "bars").drop("loaded_at"), ["series_id", "time"], ["bar_id"]).withColumnRenamed("time", "ts")
    return numbered(b.where(~Q.bad_bar() & (F.col("low") > 0)), KEY)


_CB = """cb as (select series_id, symbol, time as ts, open, high, low, close, volume, bar_id, row_number() over (partition by series_id order by time) - 1 as bar_idx
  from (select * from bars qualify row_number() over (partition by series_id, time order by bar_id desc) = 1))"""
_BAD = "(ts is null or open is null or high is null or low is null or close is null or coalesce(low > high or open < low or open > high or close < low or close > high, false))"
_GB = _CB + f""", gb as (select series_id, symbol, ts, open, high, low, close, volume, row_number() over (partition by series_id order by ts) - 1 as bar_idx from cb where not {_BAD} and low > 0)"""


# --- ticks to bars -----------------------------------------------------------------------------------------------------


@query(f"with {_TICKS}, {_TBARS} select symbol, bts as ts, open, high, low, close, vol_sum, tick_count from tbars")
def ohlcv_bars(spark, d):
    return B.tick_bars(event_ticks(spark, d), BAR_S)


_FILLED = f"""with {_TICKS}, {_TBARS}, src as (select symbol, coalesce(sum(vol_sum), 0) > 0 as has from tbars where hour(bts) <> 17 group by symbol),
days as (select distinct symbol, cast(ts + interval 6 hours as date) as session from ticks),
span as (select symbol, time_bucket(interval 15 minutes, min(ts)) as a, time_bucket(interval 15 minutes, max(ts) + interval 15 minutes - interval 1 microsecond) as b from ticks group by symbol),
grid as (select symbol, unnest(generate_series(a, b, interval 15 minutes)) as ts from span),
g as (select grid.symbol, grid.ts from grid join days on grid.symbol = days.symbol and cast(grid.ts + interval 6 hours as date) = days.session where hour(grid.ts) <> 17),
j as (select g.symbol, g.ts, t.open, t.high, t.low, t.close, case when has then coalesce(vol_sum, 0) else cast(tick_count as double) end as volume, t.symbol is not null as there
  from g left join tbars t on g.symbol = t.symbol and g.ts = t.bts join src on src.symbol = g.symbol),
f as (select *, last_value(close ignore nulls) over (partition by symbol order by ts rows unbounded preceding) as c from j)
select symbol, ts, coalesce(open, c) as open, coalesce(high, c) as high, coalesce(low, c) as low, c as close, case when there then volume else 0.0 end as volume from f where c is not null"""


@query(_FILLED)
def ohlcv_bars_filled(spark, d):
    return B.filled_bars(event_ticks(spark, d), BAR_S)


@query(f"with {_TICKS} select distinct symbol, cast(ts + interval 6 hours as date) as session from ticks")
def session_dates(spark, d):
    return event_ticks(spark, d).select("symbol", B.session_date(F.col("ts")).alias("session")).distinct()


@query(f"with {_TICKS}, {_TBARS} select symbol, coalesce(sum(vol_sum), 0) > 0 as has_volume from tbars group by symbol")
def volume_source(spark, d):
    return B.volume_source(B.tick_bars(event_ticks(spark, d), BAR_S))


@query(f"with {_TICKS} select symbol, min(ts) as first_ts, max(ts) as last_ts, sum((hour(ts) = 17)::int)::bigint as in_closed_hour, count(*) as n from ticks group by symbol")
def time_bounds(spark, d):
    return event_ticks(spark, d).groupBy("symbol").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(B.in_closed_hour(F.col("ts"))).alias("in_closed_hour"), F.count("*").alias("n"))


@query("select tick_id, bid as bid_px, ask as ask_px, (bid + ask) / 2 as mid_px from tick where bid is not null and ask is not null")
def price_sources(spark, d):
    t = table(spark, d, "tick").dropna(subset=["bid", "ask"])
    return t.select("tick_id", *[B.price(s).alias(f"{s}_px") for s in ("bid", "ask", "mid")])


@query(r"""select tick_id, try_strptime(case when length(trim(dt, chr(32)||chr(9))) < 18 then trim(dt, chr(32)||chr(9)) || '000' else trim(dt, chr(32)||chr(9)) end, '%Y%m%d %H%M%S%g') as ts
from tick where regexp_full_match(trim(dt, chr(32)||chr(9)), '\d{8} (\d{6}|\d{9})')""")
def compact_tick_times(spark, d):
    t = table(spark, d, "tick").withColumn("_t", F.trim("dt", F.lit(" \t"))).where(F.col("_t").rlike(r"^\d{8} (\d{6}|\d{9})$"))
    return t.select("tick_id", B.compact_time(F.col("_t")).alias("ts"))


@query("with b as (select symbol, time_bucket(interval 1 day, o_orderdate) as ts, o_totalprice, o_orderdate, o_orderkey from (select *, o_orderpriority as symbol from orders)) select symbol, ts, arg_min(o_totalprice, (o_orderdate, o_orderkey)) as open, max(o_totalprice) as high, min(o_totalprice) as low, arg_max(o_totalprice, (o_orderdate, o_orderkey)) as close, count(*) as tick_count from b group by all")
def daily_bars(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("px"), F.lit(None).cast("double").alias("vol"))
    return B.tick_bars(o, 86_400).drop("vol_sum")


# --- quality ------------------------------------------------------------------------------------------------------------

_VALID = "(high + 1e-8 >= open and high + 1e-8 >= close and low - 1e-8 <= open and low - 1e-8 <= close and high + 1e-8 >= low)"


@query(f"with {_CB} select series_id, avg(coalesce({_VALID}, false)::int::double) as validity, count(*) as n from cb group by series_id")
def ohlc_validity(spark, d):
    return Q.validity(clean_bars(spark, d), KEY)


def _permutations_sql() -> str:
    from itertools import permutations

    cols = ["low", "close", "high", "open"]
    parts = []
    for k, p in enumerate(permutations(range(4))):
        o, h, lo, c = (cols[i] for i in p)
        roles = "".join("ohlc"[p.index(i)] for i in range(4))
        parts.append(f"select series_id, {k} as perm, '{roles}' as roles, avg(coalesce({h} + 1e-8 >= {o} and {h} + 1e-8 >= {c} and {lo} - 1e-8 <= {o} and {lo} - 1e-8 <= {c} and {h} + 1e-8 >= {lo}, false)::int::double) as score from cb group by series_id")
    return f"with {_CB}, s as ({' union all '.join(parts)}) select series_id, first(roles order by score desc, perm) as roles, max(score) as score from s group by series_id"


@query(_permutations_sql())
def ohlc_permutations(spark, d):
    """The columns are given as low, close, high, open; the roles must come out again."""
    return Q.best_permutation(clean_bars(spark, d), ["low", "close", "high", "open"], KEY)


@query(f"with {_CB} select series_id, sum({_BAD}::int)::bigint as bad, count(*) as n, sum({_BAD}::int) / count(*) as ratio, sum({_BAD}::int) / count(*) <= 0.05 as accepted from cb group by series_id")
def bad_bars(spark, d):
    return Q.bad_bar_report(clean_bars(spark, d), KEY)


_LABEL = "case when seconds < 60 then seconds || 's' when seconds < 3600 then (seconds // 60) || 'min' when seconds < 86400 then (seconds // 3600) || 'h' else (seconds // 86400) || 'd' end"


@query(f"with {_CB}, x as (select series_id, epoch_us(ts) - epoch_us(lag(ts) over (partition by series_id order by bar_idx)) as d from cb where bar_idx <= 50), m as (select series_id, quantile_cont(d / 1e6, 0.5) as m from x group by series_id), s as (select series_id, case when m > 0 then floor(m)::bigint end as seconds from m) select series_id, seconds, {_LABEL} as label from s")
def bar_period(spark, d):
    return Q.head_period(clean_bars(spark, d), KEY)


@query(f"with {_CB}, x as (select series_id, (epoch_us(ts) - epoch_us(lag(ts) over (partition by series_id order by bar_idx))) / 1e6 as d from cb) select series_id, round(quantile_cont(d, 0.5), 6) as seconds from x where d > 0 group by series_id")
def bar_seconds(spark, d):
    return rounded(Q.all_period(I.time_deltas(clean_bars(spark, d), KEY), KEY), "seconds", n=6)


@query(rf"with {_CB} select series_id, max(greatest(" + ", ".join(rf"coalesce(length(regexp_replace(regexp_extract({c}::varchar, '\.(\d+)', 1), '0+$', '')), 0)" for c in ("open", "high", "low", "close")) + "))::int as decimals from cb where bar_idx < 50 group by series_id")
def price_precision(spark, d):
    return Q.head_precision(clean_bars(spark, d), KEY)


@query(f"with {_CB}, s as (select series_id, count(*) as n, avg(coalesce(high >= greatest(open, close) - 1e-8, false)::int::double) as high_ok, avg(coalesce(low <= least(open, close) + 1e-8, false)::int::double) as low_ok, avg(coalesce(low >= greatest(open, close) - 1e-8, false)::int::double) as low_above, avg(coalesce(high <= least(open, close) + 1e-8, false)::int::double) as high_below from cb group by series_id) select *, case when n <= 10 or (high_ok >= 0.9 and low_ok >= 0.9) then 'ok' when low_above > 0.5 then 'open_low_swapped' when high_below > 0.5 then 'open_high_swapped' else 'unclear' end as verdict from s")
def swap_checks(spark, d):
    return Q.swap_checks(clean_bars(spark, d), KEY)


@query("with x as (select * from kline where datetime is not null and close > 0) select batch_id, datetime, arg_max(open, kline_id) as open, arg_max(close, kline_id) as close, max(kline_id) as kline_id from x group by batch_id, datetime")
def kline_keep_last(spark, d):
    k = table(spark, d, "kline").where("datetime is not null and close > 0").select("batch_id", "datetime", "kline_id", "open", "close")
    return Q.keep_last(k, ["batch_id", "datetime"], ["kline_id"])


@query(r"""with p as (select file_id, string_split_regex(line, '[,\t]') as f from tick_line)
select file_id, avg(coalesce(regexp_full_match(trim(f[1]), '\d{8}') and regexp_full_match(trim(f[2]), '\d{6,9}'), false)::int::double) as share, max(len(f))::int as columns,
  case when avg(coalesce(regexp_full_match(trim(f[1]), '\d{8}') and regexp_full_match(trim(f[2]), '\d{6,9}'), false)::int::double) > 0.8 and max(len(f)) >= 5 then 'ticks_5col' else 'ticks_4col' end as layout from p group by file_id""")
def tick_layout_vote(spark, d):
    return Q.layout_vote(table(spark, d, "tick_line"), ["file_id"])


@query("with h as (select file_id, arg_min(line, (line_no, line_id)) as head from tick_line where line is not null group by file_id) select file_id, case when length(head) - length(replace(head, chr(9), '')) >= 3 then 'tab' else 'comma' end as delimiter from h")
def delimiter_detect(spark, d):
    x = table(spark, d, "tick_line").withColumn("_o", F.struct("line_no", "line_id"))
    return Q.first_line_delimiter(x, ["file_id"], order="_o")


@query("select file_id, line_no, line_id, line from tick_line qualify row_number() over (partition by file_id order by line_no, line_id) <= 50")
def first_rows(spark, d):
    """Head of every file: its first fifty lines by number, then id."""
    x = table(spark, d, "tick_line").select("file_id", "line_no", "line_id", "line")
    return x.withColumn("_n", F.row_number().over(Window.partitionBy("file_id").orderBy("line_no", "line_id"))).where("_n <= 50").drop("_n")


@query("select file_name, case when regexp_extract(upper(file_name), '([A-Z]{6})', 1) <> '' then substr(regexp_extract(upper(file_name), '([A-Z]{6})', 1), 1, 3) when regexp_extract(upper(file_name), '(XAG|XAU|BTC|ETH|EUR|GBP|JPY|AUD|CAD|CHF|NZD)', 1) <> '' then regexp_extract(upper(file_name), '(XAG|XAU|BTC|ETH|EUR|GBP|JPY|AUD|CAD|CHF|NZD)', 1) else 'UNK' end as symbol from drift_file")
def inferred_symbols(spark, d):
    return table(spark, d, "drift_file").select("file_name", Q.infer_symbol(F.col("file_name")).alias("symbol"))


@query("select series_id, period_s, case when period_s >= 60 and period_s % 3600 = 0 then (period_s // 3600) || 'h' when period_s >= 60 and period_s % 60 = 0 then (period_s // 60) || 'm' else period_s || 's' end as label, greatest(1, round_even(50 * 60 / period_s, 0))::bigint as bars from series")
def period_labels(spark, d):
    s = table(spark, d, "series")
    bars = F.greatest(F.lit(1), F.bround(F.lit(50 * 60) / F.col("period_s"), 0))
    return s.select("series_id", "period_s", Q.exact_period_label(F.col("period_s")).alias("label"), bars.cast("long").alias("bars"))


# --- windows ------------------------------------------------------------------------------------------------------------

_RUNS = f"""{_CB}, z as (select *, max(case when volume = 0 then null else bar_idx end) over (partition by series_id order by bar_idx rows unbounded preceding) as run from cb),
runs as (select series_id, coalesce(run, -1) as run, min(bar_idx) as first_idx, max(bar_idx) as last_idx, min(ts) as from_ts, max(ts) as to_ts, count(*) as bars, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as span_s from z where volume = 0 group by series_id, coalesce(run, -1))"""
_RET = f"""{_RUNS}, halt as (select series_id, first_idx, last_idx from runs where span_s >= 180),
rr as (select cb.*, case when close > 0 then ln(close) end - lag(case when close > 0 then ln(close) end) over w as raw, coalesce(ts::date <> lag(ts::date) over w, true) as first_of_day,
  exists (select 1 from halt h where h.series_id = cb.series_id and cb.bar_idx between h.first_idx and h.last_idx) as in_halt, exists (select 1 from halt h where h.series_id = cb.series_id and cb.bar_idx = h.last_idx + 1) as after_halt
  from cb window w as (partition by series_id order by bar_idx)),
ret as (select series_id, bar_idx, ts, first_of_day, in_halt, case when not first_of_day and not in_halt and not after_halt then raw * 100 end as ret from rr),
kept as (select *, row_number() over (partition by series_id order by bar_idx) - 1 as ret_idx from ret where ret is not null)"""


@query(f"with {_RET} select series_id, bar_idx, first_of_day, in_halt, round(ret, 9) as ret from ret")
def log_returns(spark, d):
    x = I.log_returns(clean_bars(spark, d), KEY, scale=100.0)
    return rounded(x.select("series_id", "bar_idx", "first_of_day", "in_halt", "ret"), "ret")


@query(f"with {_RUNS} select series_id, first_idx, last_idx, from_ts, to_ts, bars, span_s, span_s >= 180 as halted from runs")
def zero_volume_runs(spark, d):
    return I.halts(clean_bars(spark, d), KEY)


def _returns(spark, d) -> DataFrame:
    x = I.log_returns(clean_bars(spark, d), KEY, scale=100.0).where("ret is not null")
    x = ranked(x.withColumn("_b", F.floor(F.col("bar_idx") / 8192)), KEY, "_b", ["bar_idx"])
    return x.select("series_id", "ts", F.col("_rank").alias("ret_idx"), "ret")


@query(f"with {_RET} select series_id, ret_idx, case when count(ret) over w = {WIDTH} then round(sum(ret * ret) over w, 9) end as rv from kept window w as (partition by series_id order by ret_idx rows between 1 following and {WIDTH} following)")
def realized_variance_fwd(spark, d):
    x = I.forward_variance(_returns(spark, d), KEY, WIDTH)
    return rounded(x.select("series_id", "ret_idx", "rv"), "rv")


@query(f"""with {_CB}, x as (select *, (epoch_us(ts) - epoch_us(lag(ts) over (partition by series_id order by bar_idx))) / 1e6 as d from cb), u as (select series_id, quantile_cont(d, 0.5) as m from x where d > 0 group by series_id)
select series_id, ts, close, false as separator from cb union all select x.series_id, ts - to_microseconds(((d - m) * 1000000)::bigint), null, true from x join u using (series_id) where d > m * 2""")
def gap_separators(spark, d):
    return I.gap_separators(clean_bars(spark, d), KEY)


_RRV = f"""{_CB}, f as (select series_id, bar_idx, ts, count(*) over w as n, first_value(open) over w as o, max(high) over w as h, min(low) over w as l from cb window w as (partition by series_id order by bar_idx rows between {WIDTH - 1} preceding and current row)),
rrv as (select series_id, bar_idx, ts, case when n = {WIDTH} and o <> 0 then (h - o) / o end as rrv_up, case when n = {WIDTH} and o <> 0 then (o - l) / o end as rrv_down from f)"""


def _rrv(spark, d) -> DataFrame:
    return I.rolling_range_volatility(clean_bars(spark, d), KEY, WIDTH).select("series_id", "bar_idx", "ts", "rrv_up", "rrv_down")


@query(f"with {_RRV} select * from rrv where rrv_up is not null and rrv_down is not null")
def rrv(spark, d):
    return _rrv(spark, d).dropna(subset=["rrv_up", "rrv_down"])


_STATS = ", ".join(f"round(quantile_cont(v, {p}), 12) as p{int(p * 100):02d}" for p in I.STATS)


@query(f"""with v as (select symbol, rrv_up as v, bar_date as ts from signal_rrv where isfinite(rrv_up)) select symbol, count(*) as n, min(ts) as "start", max(ts) as "end", round(avg(v), 9) as mean, round(case when count(*) > 1 then stddev_samp(v) else 0 end, 9) as std, min(v) as "min", max(v) as "max",
count(*) filter (v > 0.01) as over_1pct, avg((v > 0.01)::int::double) as share_over_1pct, {_STATS} from v group by symbol""")
def rrv_stats(spark, d):
    x = I.range_stats(table(spark, d, "signal_rrv"), ["symbol"], "rrv_up", "signal_id", "bar_date")
    return rounded(rounded(x, "mean", "std"), *[f"p{int(p * 100):02d}" for p in I.STATS], n=12)


@query(f"""with v as (select series_id, rrv_down as v from signal_rrv where isfinite(rrv_down)), u as (select series_id, greatest(case when quantile_cont(v, 0.997) > 0 then quantile_cont(v, 0.997) else max(v) end * 1.05, 1e-6) as u from v group by series_id),
k as (select v.series_id, v, u from v join u using (series_id)), e as (select series_id, min(v) as a, max(v) as b from k where v <= u group by series_id),
w as (select series_id, case when a = b then a - 0.5 else a end as lo, ((case when a = b then b + 0.5 else b end) - (case when a = b then a - 0.5 else a end)) / 120 as w from e),
c as (select series_id, count(*) filter (v > u) as clipped from k group by series_id)
select series_id, least(floor((v - lo) / w), 119)::bigint as bin, count(*) as n, any_value(clipped) as clipped from k join w using (series_id) join c using (series_id) where v <= u group by all""")
def rrv_histogram(spark, d):
    return I.histogram(table(spark, d, "signal_rrv"), KEY, "rrv_down", "signal_id").select("series_id", "bin", "n", "clipped")


_FOLDS = f"""{_CB}, w as (select series_id, bar_idx, list(open) over w as o, list(high) over w as h, list(low) over w as l, list(close) over w as c, count(open) over w as n1, count(high) over w as n2, count(low) over w as n3, count(close) over w as n4
  from cb window w as (partition by series_id order by bar_idx rows between {WIDTH - 1} preceding and current row)),
f as (select *, least(n1, n2, n3, n4) = {WIDTH} as whole, list_min(l) as lmin, {WIDTH} + 1 - list_position(list_reverse(l), list_min(l)) as k, list_max(h) as hmax, {WIDTH} + 1 - list_position(list_reverse(h), list_max(h)) as q from w)"""


@query(f"""with {_FOLDS}, g as (select *, greatest(c[1], list_max(h[2:])) as peak, case when list_max(h[2:]) > c[1] then 1 + list_position(h[2:], list_max(h[2:])) else 1 end as p, least(c[1], list_min(l[2:])) as trough, case when list_min(l[2:]) < c[1] then 1 + list_position(l[2:], list_min(l[2:])) else 1 end as t from f)
select series_id, bar_idx, case when whole then greatest(c[k], list_max(h[k+1:])) - lmin end as increase, case when whole then lmin end as inc_base,
case when whole then greatest(case when k = 1 then case when o[1] >= c[1] then h[1] else c[1] end else c[k] end, list_max(h[k+1:])) - lmin end as window_increase,
case when whole then peak end as peak, case when whole then peak - least(c[p], list_min(l[p+1:])) end as withdrawal,
case when whole then hmax - least(c[q], list_min(l[q+1:])) end as decrease, case when whole then hmax end as dec_base, case when whole then trough end as trough, case when whole then greatest(c[t], list_max(h[t+1:])) - trough end as rebound,
case when whole then (k - 1)::double end as low_offset, case when whole then (case when abs(list_max(h[2:]) - c[1]) <= 1e-10 then 0 else list_position(h[2:], list_max(h[2:])) end)::double end as high_offset, case when whole then hmax - list_max(h[:{WIDTH - LAG}]) end as speed from g""")
def rolling_folds(spark, d):
    return I.rolling_folds(clean_bars(spark, d), "series_id", WIDTH, LAG).drop("max_wd", "max_rebound")


def _worst(high: str, low: str, big: str, small: str) -> str:
    """Largest loss share over the ends t of prefixes, each from its first running extreme; the mirror has its sign turned."""
    sign, nearer = ("", "least") if small == "list_min" else ("-", "greatest")
    peak = f"{big}({high}[1:t])"
    at = f"list_position({high}[1:t], {peak})"
    return f"list_max(list_transform(range(2, {WIDTH + 1}), lambda t: {sign}({peak} - {nearer}(c[{at}], {small}({low}[{at} + 1:t]))) / nullif(abs({peak}), 0)))"


@query(f"with {_FOLDS} select series_id, bar_idx, case when whole then round(greatest(0, {_worst('h', 'l', 'list_max', 'list_min')}), 9) end as max_wd, case when whole then round(greatest(0, {_worst('l', 'h', 'list_min', 'list_max')}), 9) end as max_rebound from f")
def rolling_max_drawdown(spark, d):
    x = I.rolling_folds(clean_bars(spark, d), "series_id", WIDTH, LAG).where("true")
    return rounded(x.select("series_id", "bar_idx", "max_wd", "max_rebound"), "max_wd", "max_rebound")


@query(f"with {_CB}, f as (select series_id, arg_min(open, bar_idx) as f from cb group by series_id) select series_id, bar_idx, case when f <> 0 then open / f * 100 end as open, case when f <> 0 then high / f * 100 end as high, case when f <> 0 then low / f * 100 end as low, case when f <> 0 then close / f * 100 end as close from cb join f using (series_id)")
def normalized_price(spark, d):
    return I.to_first_open(clean_bars(spark, d), KEY).select("series_id", "bar_idx", "open", "high", "low", "close")


@query(f"with {_CB} select series_id, bar_idx - 51 as bar_idx, close as open, close as high, close as low, close from cb where bar_idx > 50 and bar_idx < 200")
def index_slice(spark, d):
    return I.only_close(I.index_slice(clean_bars(spark, d), 50, 200)).select("series_id", "bar_idx", "open", "high", "low", "close")


@query(f"with {_RET}, n as (select series_id, count(*) as n from kept group by series_id) select series_id, ret_idx, ret_idx < least(greatest(floor(n * 0.7), 10), n - 10) as is_train from kept join n using (series_id)")
def chronological_split(spark, d):
    return G.split_rows(_returns(spark, d), KEY, "ret_idx").select("series_id", "ret_idx", "is_train")


# --- strategies and their ledgers ---------------------------------------------------------------------------------------

CLOSE_BAR, SPEED = 6, 0.0005
ALWAYS = S.Params(0, "always_in", open_bar=WIDTH, close_bar=CLOSE_BAR, close_threshold=SPEED)
LONG = S.Params(1, "long", WIDTH, 0.001, 0.001, 0.001, WIDTH, 0.0005, 0.001)
SHORT = S.Params(2, "short", WIDTH, 0.001, 0.001, 0.001, WIDTH, 0.0001, 0.001)
LEGACY = S.Params(3, "legacy", WIDTH, 1e-6, 1e-6, 0.001, WIDTH, 1e-6, 0.001)
RUN = ["series_id", "param_id"]

_CHAIN = f"""{_GB}, pairs as (select e.series_id, e.bar_idx as e, x.bar_idx as x, max(x.high) over (partition by e.series_id, e.bar_idx order by x.bar_idx rows unbounded preceding) as m from gb e join gb x on e.series_id = x.series_id and x.bar_idx >= e.bar_idx),
ex as (select p.series_id, e, min(x) as x from (select *, lag(m, {CLOSE_BAR}) over (partition by series_id, e order by x) as m0 from pairs) p join gb b on b.series_id = p.series_id and b.bar_idx = p.x - {CLOSE_BAR} + 1 where x - e >= {CLOSE_BAR} and case when b.low <> 0 then (m - m0) / abs(b.low) else 0 end < {SPEED} group by p.series_id, e),
chain as (select series_id, 0::bigint as e from (select distinct series_id from gb) union all select c.series_id, ex.x + 1 from chain c join ex on ex.series_id = c.series_id and ex.e = c.e join gb on gb.series_id = c.series_id and gb.bar_idx = ex.x + 1),
tr as (select c.series_id, row_number() over (partition by c.series_id order by c.e) as trade_id, c.e as entry_idx, a.ts as entry_ts, a.open as entry_price, ex.x as exit_idx, b.ts as exit_ts, b.close as exit_price, b.close / a.open as percent
  from chain c join ex on ex.series_id = c.series_id and ex.e = c.e join gb a on a.series_id = c.series_id and a.bar_idx = c.e join gb b on b.series_id = c.series_id and b.bar_idx = ex.x),
entries as (select c.series_id, c.e, gb.open as cost, coalesce(ex.x, 9223372036854775807) as x from chain c join gb on gb.series_id = c.series_id and gb.bar_idx = c.e left join ex on ex.series_id = c.series_id and ex.e = c.e),
kk as (select series_id, entry_idx, exit_idx, 100 * product(percent) over (partition by series_id order by trade_id rows unbounded preceding) as k from tr),
perf as (select gb.series_id, gb.bar_idx, gb.ts, case when gb.bar_idx = n.e then k0 when gb.bar_idx = n.x then k0 * gb.close / cost else k0 * (gb.close / cost) end as capital
  from gb join (select entries.*, coalesce((select arg_max(k, exit_idx) from kk where kk.series_id = entries.series_id and kk.exit_idx < entries.e), 100.0) as k0 from entries) n on n.series_id = gb.series_id and gb.bar_idx between n.e and n.x)"""


def _book(spark, d, p: S.Params) -> tuple[DataFrame, DataFrame]:
    bars = materialize(good_bars(spark, d), "bars")
    return bars, materialize(L.ledger(S.run_strategy(bars, [p], "series_id"), RUN, -1 if p.kind == "short" else 1), "book")


@query(f"with recursive {_CHAIN} select series_id, trade_id, entry_idx, entry_ts, entry_price, exit_idx, exit_ts, exit_price, round(percent, 9) as percent, 2 as close_type from tr")
def always_in_trades(spark, d):
    t = L.trades(_book(spark, d, ALWAYS)[1], RUN)
    return rounded(t.select("series_id", F.col("trade_id").cast("long").alias("trade_id"), "entry_idx", "entry_ts", "entry_price", "exit_idx", "exit_ts", "exit_price", "percent", "close_type"), "percent")


@query(f"with recursive {_CHAIN} select series_id, bar_idx, round(capital, 6) as capital from perf")
def always_in_performance(spark, d):
    return rounded(_book(spark, d, ALWAYS)[1].select("series_id", "bar_idx", "capital"), "capital", n=6)


_INSIDE = """ins as (select tr.series_id, trade_id, entry_idx, entry_price, exit_idx, exit_price, gb.bar_idx, gb.ts, gb.high, gb.low, gb.close from tr join gb on gb.series_id = tr.series_id and gb.bar_idx between entry_idx and exit_idx),
tops as (select series_id, trade_id, first(bar_idx order by high desc, bar_idx) as ti, max(high) as tp from ins group by series_id, trade_id)"""


@query(f"with recursive {_CHAIN}, {_INSIDE}, dips as (select ins.series_id, ins.trade_id, first(bar_idx order by low, bar_idx) as di, min(low) as dp from ins join tops on tops.series_id = ins.series_id and tops.trade_id = ins.trade_id where bar_idx <= ti group by all) select tr.series_id, tr.trade_id, exit_idx - entry_idx + 1 as holding_bars, round((exit_price / entry_price - 1) * 100, 9) as realized_pct, round((tp / entry_price - 1) * 100, 9) as max_profit_pct, ti as max_profit_idx, tp as max_profit_price, round((dp / entry_price - 1) * 100, 9) as max_loss_pct, di as max_loss_idx, dp as max_loss_price from tr join tops on tops.series_id = tr.series_id and tops.trade_id = tr.trade_id join dips on dips.series_id = tr.series_id and dips.trade_id = tr.trade_id")
def trade_extremes(spark, d):
    bars, book = _book(spark, d, ALWAYS)
    x = L.trade_extremes(L.trades(book, RUN), bars, RUN, KEY)
    x = x.select("series_id", F.col("trade_id").cast("long").alias("trade_id"), "holding_bars", "realized_pct", "max_profit_pct", "max_profit_idx", "max_profit_price", "max_loss_pct", "max_loss_idx", "max_loss_price")
    return rounded(x, "realized_pct", "max_profit_pct", "max_loss_pct")


@query(f"""with recursive {_CHAIN}, {_INSIDE}, seg as (select ins.*, ti, row_number() over (partition by ins.series_id, ins.trade_id order by bar_idx) as n from ins join tops on tops.series_id = ins.series_id and tops.trade_id = ins.trade_id where bar_idx <= ti),
lists as (select series_id, trade_id, any_value(ti) as ti, any_value(entry_idx) as e, list(high order by bar_idx) as h, list(low order by bar_idx) as l, list(close order by bar_idx) as c from seg group by series_id, trade_id),
pk as (select *, greatest(c[1], list_max(h[2:])) as peak, case when list_max(h[2:]) > c[1] then 1 + list_position(h[2:], list_max(h[2:])) else 1 end as k from lists)
select series_id, trade_id, ti as max_profit_idx, ti - e + 1 as segment_bars, peak as segment_peak, round(peak - least(c[k], list_min(l[k+1:])), 9) as segment_withdrawal, round((peak - least(c[k], list_min(l[k+1:]))) / peak * 100, 9) as withdrawal_pct from pk""")
def entry_to_max_profit(spark, d):
    bars, book = _book(spark, d, ALWAYS)
    x = L.entry_to_max_profit(L.trades(book, RUN), bars, RUN, KEY)
    return rounded(x.select("series_id", F.col("trade_id").cast("long").alias("trade_id"), "max_profit_idx", "segment_bars", "segment_peak", "segment_withdrawal", "withdrawal_pct"), "segment_withdrawal", "withdrawal_pct")


@query(f"""with recursive {_CHAIN}, n as (select series_id, count(*) as entries from entries group by series_id), x as (select series_id, count(*) as exits, arg_max(exit_idx, exit_idx) as last from tr group by series_id),
top as (select series_id, max(capital) as hi from perf group by series_id), tat as (select p.series_id, min(bar_idx) as i, any_value(hi) as hi from perf p join top using (series_id) where capital = hi group by p.series_id),
back as (select p.series_id, any_value(hi) as hi, any_value(hi) - min(capital) as b from perf p join tat using (series_id) where bar_idx >= i group by p.series_id),
fin as (select series_id, round(arg_max(k, exit_idx), 2) as k from kk group by series_id), dd as (select series_id, max(top - capital) as dd from (select *, max(capital) over (partition by series_id order by bar_idx rows unbounded preceding) as top from perf) group by series_id)
select n.series_id, case when entries + coalesce(exits, 0) > 1 then k else 100.0 end as capital, 0 as closed_by_withdrawal, round(dd, 6) as max_drawdown, (entries + coalesce(exits, 0)) / 2 as trade_num, coalesce(exits, 0) as closed_by_speed, round(hi, 6) as outcome_high, round(b, 6) as biggest_back from n left join x using (series_id) left join fin using (series_id) join back using (series_id) join dd using (series_id)""")
def outcome_stats(spark, d):
    x = L.outcome_stats(_book(spark, d, ALWAYS)[1], RUN)
    return rounded(x.select("series_id", "capital", "trade_num", "closed_by_withdrawal", "closed_by_speed", "outcome_high", "biggest_back", "max_drawdown"), "outcome_high", "biggest_back", "max_drawdown", n=6)


@query(f"with recursive {_CHAIN}, f as (select series_id, arg_min(capital, bar_idx) as c0 from perf group by series_id) select gb.series_id, gb.bar_idx, round(coalesce((select arg_max(k, exit_idx) from kk where kk.series_id = gb.series_id and kk.exit_idx <= gb.bar_idx), c0), 6) as anchor from gb join f using (series_id)")
def capital_anchors(spark, d):
    return rounded(L.capital_anchors(_book(spark, d, ALWAYS)[1], RUN).select("series_id", "bar_idx", "anchor"), "anchor", n=6)


@query(f"with recursive {_CHAIN}, f as (select series_id, arg_min(open, bar_idx) as f from gb group by series_id) select tr.series_id, trade_id, entry_idx, entry_price / f * 100 as entry_y, exit_idx, exit_price / f * 100 as exit_y from tr join f using (series_id)")
def trade_links(spark, d):
    """Ends of each trade's line, with the first open as 100."""
    bars, book = _book(spark, d, ALWAYS)
    first = bars.groupBy("series_id").agg(F.min_by("open", "bar_idx").alias("_f"))
    t = L.trades(book, RUN).join(first, "series_id")
    return t.select("series_id", F.col("trade_id").cast("long").alias("trade_id"), "entry_idx", (F.col("entry_price") / F.col("_f") * 100).alias("entry_y"), "exit_idx", (F.col("exit_price") / F.col("_f") * 100).alias("exit_y"))


@query(f"with recursive {_CHAIN}, x as (select tr.series_id, trade_id, tr.exit_price - entry_price as pnl from tr) select series_id, trade_id, pnl, row_number() over (partition by series_id order by pnl desc, trade_id) as rank, case when abs(pnl) <= 1e-12 then 1e-4 else pnl end as shown from x")
def ranked_trades(spark, d):
    """Trades by profit, those at zero lifted to a visible floor."""
    t = L.trades(_book(spark, d, ALWAYS)[1], RUN).withColumn("pnl", F.col("exit_price") - F.col("entry_price"))
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("pnl"), "trade_id")).cast("long")
    return t.select("series_id", F.col("trade_id").cast("long").alias("trade_id"), "pnl", rank.alias("rank"), F.when(F.abs("pnl") <= 1e-12, 1e-4).otherwise(F.col("pnl")).alias("shown"))


@query(f"""with recursive {_CHAIN}, one as (select series_id, first(entry_idx order by abs(entry_idx - 120), entry_idx) as entry_idx from tr group by series_id), t as (select tr.* from tr join one on one.series_id = tr.series_id and one.entry_idx = tr.entry_idx)
select gb.series_id, gb.bar_idx, gb.close, t.entry_idx, t.exit_idx, exit_price - entry_price as pnl, (exit_price - entry_price) / entry_price * 100 as pnl_pct from gb join t on t.series_id = gb.series_id and gb.bar_idx between t.entry_idx - 100 and t.exit_idx + 100""")
def observe_slice(spark, d):
    bars, book = _book(spark, d, ALWAYS)
    return L.observe(L.trades(book, RUN), bars, KEY, 120).select("series_id", "bar_idx", "close", "entry_idx", "exit_idx", "pnl", "pnl_pct")


def _runs(*sets: S.Params) -> str:
    return f"with recursive {_GB}, {machine_sql(list(sets))}, {book_sql()}"


def _trades_of(p: S.Params):
    def run(spark, d):
        t = L.trades(_book(spark, d, p)[1], RUN)
        x = t.select("series_id", F.col("trade_id").cast("long").alias("trade_id"), "entry_idx", "entry_ts", "entry_price", "exit_idx", "exit_ts", "exit_price", "close_type", "percent", "capital")
        return rounded(x, "percent", "capital", n=6)

    return run


_TRADE_SQL = "select series_id, trade_id, entry_idx, entry_ts, entry_price, exit_idx, exit_ts, exit_price, close_type, round(percent, 6) as percent, round(capital, 6) as capital from trade"
for _name, _p in (("long_momentum_trades", LONG), ("short_momentum_trades", SHORT), ("legacy_long_trades", LEGACY)):
    QUERIES[_name] = _trades_of(_p)
    SQL[_name] = f"{_runs(_p)} {_TRADE_SQL}"

#: Measures of a signal that are prices or sums of prices, compared to nine places.
_MEASURES = ["withdrawal", "increase", "ana_inc", "total_inc", "holding_wd", "holding_inc", "low_price", "high_price", "execution"]


def _signals_of(p: S.Params):
    def run(spark, d):
        return rounded(S.run_strategy(good_bars(spark, d), [p], "series_id"), *_MEASURES)

    return run


_ROUNDED = ", ".join(f"round({c}, 9) as {c}" for c in _MEASURES)
for _name, _p in (("long_momentum_signal", LONG), ("short_momentum_signal", SHORT), ("legacy_long_signal", LEGACY)):
    QUERIES[_name] = _signals_of(_p)
    SQL[_name] = f"{_runs(_p)} select * replace ({_ROUNDED}) from signals"


@query(f"{_runs(LONG)}, d as (select s.* exclude (wd_signal, inc_signal, total_inc_signal, holding_wd_signal, speed_close_signal, have_holding, last_index, low_index, high_index, close, ts), s.ts, gb.open, gb.high, gb.low, gb.close, gb.volume, round(book.capital, 6) as capital from signals s join gb on gb.series_id = s.series_id and gb.bar_idx = s.bar_idx join book on book.series_id = s.series_id and book.bar_idx = s.bar_idx) select * replace ({_ROUNDED}) from d")
def detail(spark, d):
    """Signals, bars and capital side by side, without the flags that only steer."""
    bars = materialize(good_bars(spark, d), "bars")
    signals = materialize(S.run_strategy(bars, [LONG], "series_id"), "signals")
    book = L.ledger(signals, RUN).select(*RUN, "bar_idx", "capital")
    flags = ["wd_signal", "inc_signal", "total_inc_signal", "holding_wd_signal", "speed_close_signal", "have_holding", "last_index", "low_index", "high_index", "close"]
    x = signals.drop(*flags).join(bars.select("series_id", "bar_idx", "open", "high", "low", "close", "volume"), ["series_id", "bar_idx"]).join(book, [*RUN, "bar_idx"])
    return rounded(rounded(x, *_MEASURES), "capital", n=6)


@query(f"{_runs(LONG)} select series_id, param_id, bar_idx, ts, type, execution as price, case when not opened then close_type end as close_type, case when not opened then round(capital, 6) end as capital, case when not opened then round(percent, 6) end as percent, round(low_price, 9) as low_price, low_date, round(high_price, 9) as high_price, high_date, max_inc, max_wd, period from tx")
def hover_rows(spark, d):
    """Entries and exits with what the signals say about them at that bar."""
    signals = materialize(S.run_strategy(good_bars(spark, d), [LONG], "series_id"), "signals")
    tx = L.transactions(L.ledger(signals, RUN), RUN)
    x = tx.join(signals.select(*RUN, "bar_idx", "low_price", "low_date", "high_price", "high_date", "max_inc", "max_wd", "period"), [*RUN, "bar_idx"])
    return rounded(rounded(x, "capital", "percent", n=6), "low_price", "high_price")


_COUNTED = [LONG, SHORT, S.Params(4, "legacy", WIDTH, 1e-6, 1e-6, 0.001, WIDTH, 1e-6, 0.001)]


@query(f"""{_runs(*_COUNTED)}, f as (select sets.kind, s.series_id, count(*) filter (holding_signal = 1) as entries, count(*) filter (close_type = 1) as by_withdrawal, count(*) filter (close_type = 2) as by_speed, count(*) filter (holding_signal = 3) as held, count(*) filter (holding_signal = 0 and have_holding = 0) as idle, count(*) as bars from signals s join sets on sets.param_id = s.param_id group by all)
select *, held + entries + by_withdrawal + by_speed + idle = bars as adds_up from f where entries > 0""")
def close_counts(spark, d):
    """Exits by kind for each run with an entry, the bars held and idle, and whether all add up: the badge of a chart."""
    signals = S.run_strategy(good_bars(spark, d), _COUNTED, "series_id")
    kind = F.get(F.array(*[F.lit(p.kind) for p in _COUNTED]), F.array_position(F.array(*[F.lit(p.param_id).cast("long") for p in _COUNTED]), F.col("param_id")).cast("int") - 1)
    held, idle = F.col("holding_signal") == 3, (F.col("holding_signal") == 0) & (F.col("have_holding") == 0)
    x = signals.groupBy(kind.alias("kind"), "series_id").agg(F.count_if(F.col("holding_signal") == 1).alias("entries"), F.count_if(F.col("close_type") == 1).alias("by_withdrawal"), F.count_if(F.col("close_type") == 2).alias("by_speed"), F.count_if(held).alias("held"), F.count_if(idle).alias("idle"), F.count("*").alias("bars"))
    return x.where("entries > 0").withColumn("adds_up", F.expr("held + entries + by_withdrawal + by_speed + idle = bars"))


SWEEP = [S.Params(100 + 10 * i + j, "long", w, o, o, 0.001, w, 0.0005, 0.001) for i, w in enumerate((8, 12, 24)) for j, o in enumerate((0.0005, 0.001, 0.002))]
_STATS = "round(outcome_high, 6) as outcome_high, round(biggest_back, 6) as biggest_back, round(max_drawdown, 6) as max_drawdown"


@query(f"{_runs(*SWEEP)} select stats.* replace ({_STATS}), sets.open_bar, sets.open_threshold, sets.continue_threshold, sets.open_withdrawal, sets.close_bar, sets.close_threshold, sets.close_withdrawal from stats join sets on sets.param_id = stats.param_id")
def param_sweep(spark, d):
    """A grid of thresholds and windows; sets that do not fit together are passed over."""
    stats = L.outcome_stats(L.ledger(S.run_strategy(good_bars(spark, d), SWEEP, "series_id"), RUN), RUN)
    x = stats.join(F.broadcast(S.parameters(spark, SWEEP)), "param_id").drop("kind", "precision", "zero_anchor")
    return rounded(x, "outcome_high", "biggest_back", "max_drawdown", n=6)


@query(f"{_runs(SHORT)} select stats.* replace ({_STATS}) from stats")
def outcome_stats_short(spark, d):
    """Final capital, counts, trough and way back of the short machine's runs."""
    x = L.outcome_stats(_book(spark, d, SHORT)[1], RUN, -1)
    return rounded(x, "outcome_high", "biggest_back", "max_drawdown", n=6)


# --- conditional variance ------------------------------------------------------------------------------------------------

MU, OMEGA, ALPHA, BETA, H0, EPS0 = 0.0, 0.0001, 0.1, 0.85, 0.002, 0.01
_D = {k: f"({v!r}::double)" for k, v in {"MU": MU, "OMEGA": OMEGA, "ALPHA": ALPHA, "BETA": BETA, "H0": H0, "EPS0": EPS0}.items()}
_GARCH = f"""{_RET}, hv as (select series_id, 0::bigint as ret_idx, {_D['OMEGA']} + {_D['ALPHA']} * {_D['EPS0']} * {_D['EPS0']} + {_D['BETA']} * {_D['H0']} as h from kept where ret_idx = 0
  union all select v.series_id, v.ret_idx + 1, {_D['OMEGA']} + {_D['ALPHA']} * (k.ret - {_D['MU']}) * (k.ret - {_D['MU']}) + {_D['BETA']} * v.h from hv v join kept k on k.series_id = v.series_id and k.ret_idx = v.ret_idx join kept n on n.series_id = v.series_id and n.ret_idx = v.ret_idx + 1),
hs as (select hv.series_id, hv.ret_idx, h, {_D['OMEGA']} + {_D['ALPHA']} * (ret - {_D['MU']}) * (ret - {_D['MU']}) + {_D['BETA']} * h as h1 from hv join kept using (series_id, ret_idx)),
s2 as (select *, {_D['OMEGA']} / (1 - ({_D['ALPHA']} + {_D['BETA']})) * ({WIDTH} - (1 - pow({_D['ALPHA']} + {_D['BETA']}, {WIDTH})) / (1 - ({_D['ALPHA']} + {_D['BETA']}))) + h1 * ((1 - pow({_D['ALPHA']} + {_D['BETA']}, {WIDTH})) / (1 - ({_D['ALPHA']} + {_D['BETA']}))) as sigma2_hat from hs),
fv as (select series_id, ret_idx, case when count(ret) over w = {WIDTH} then sum(ret * ret) over w end as rv from kept window w as (partition by series_id order by ret_idx rows between 1 following and {WIDTH} following)),
ev as (select series_id, ret_idx, sigma2_hat, rv from s2 join fv using (series_id, ret_idx) where rv is not null)"""


def _variances(returns: DataFrame) -> DataFrame:
    x = returns.withColumns({"mu": F.lit(MU), "omega": F.lit(OMEGA), "alpha": F.lit(ALPHA), "beta": F.lit(BETA), "h0": F.lit(H0), "eps0": F.lit(EPS0)})
    return G.conditional_variance(x, KEY, "ret_idx")


@query(f"with recursive {_GARCH} select series_id, ret_idx, round(h, 9) as h from hs")
def garch_variance(spark, d):
    return rounded(_variances(_returns(spark, d)).select("series_id", "ret_idx", "h"), "h")


def _evaluated(spark, d) -> DataFrame:
    h1 = G.next_variance(F.col("ret"), F.col("h"), F.lit(MU), F.lit(OMEGA), F.lit(ALPHA), F.lit(BETA))
    returns = materialize(_returns(spark, d), "returns")
    x = _variances(returns).withColumn("h1", h1).withColumn("sigma2_hat", G.horizon_variance(F.col("h1"), WIDTH, F.lit(OMEGA), F.lit(ALPHA + BETA)))
    rv = I.forward_variance(returns, KEY, WIDTH).where("rv is not null").select("series_id", "ret_idx", "rv")
    return x.join(rv, ["series_id", "ret_idx"])


@query(f"with recursive {_GARCH} select series_id, ret_idx, round(sigma2_hat, 9) as sigma2_hat, round(rv, 9) as rv, round(sqrt(sigma2_hat), 9) as vol_hat, round(sqrt(rv), 9) as vol_real from ev")
def garch_hstep(spark, d):
    x = _evaluated(spark, d).select("series_id", "ret_idx", "sigma2_hat", "rv", F.sqrt("sigma2_hat").alias("vol_hat"), F.sqrt("rv").alias("vol_real"))
    return rounded(x, "sigma2_hat", "rv", "vol_hat", "vol_real")


_SCORES = f"""{_GARCH}, sc as (select series_id, count(*) as n, regr_intercept(rv, sigma2_hat) as a, regr_slope(rv, sigma2_hat) as b, regr_r2(rv, sigma2_hat) as r2, avg(ln(greatest(sigma2_hat, 1e-18)) + rv / greatest(sigma2_hat, 1e-18)) as qlike, avg(sigma2_hat) as mp, avg(rv) as mr, sum((rv - sigma2_hat) * (rv - sigma2_hat)) as s0, regr_syy(rv, sigma2_hat) * (1 - regr_r2(rv, sigma2_hat)) as s1 from ev group by series_id)"""


@query(f"with recursive {_SCORES} select series_id, n, round(a, 6) as intercept, round(b, 6) as slope, round(r2, 6) as r2, case when n > 2 and s1 > 0 then round(pow(1 + 2 * greatest(((s0 - s1) / 2) / (s1 / (n - 2)), 0) / (n - 2), -(n - 2) / 2), 6) end as p_value from sc")
def mz_regression(spark, d):
    x = G.forecast_scores(_evaluated(spark, d), KEY).select("series_id", "n", "intercept", "slope", "r2", "p_value")
    return rounded(x, "intercept", "slope", "r2", "p_value", n=6)


@query(f"with recursive {_SCORES} select series_id, round(qlike, 6) as qlike, round(mp, 6) as mean_pred, round(mr, 6) as mean_rv, case when mr > 0 then round(mp / mr, 6) end as ratio from sc")
def qlike(spark, d):
    x = G.forecast_scores(_evaluated(spark, d), KEY).select("series_id", "qlike", "mean_pred", "mean_rv", "ratio")
    return rounded(x, "qlike", "mean_pred", "mean_rv", "ratio", n=6)


@query(f"with recursive {_SCORES}, v as (select series_id, concat_ws(',', case when n < 300 then 'few_rows' end, case when mp / mr < 0.2 or mp / mr > 5 then 'ratio' end) as reasons from sc) select series_id, reasons, reasons = '' as valid from v")
def garch_validity(spark, d):
    x = G.forecast_scores(_evaluated(spark, d), KEY).withColumns({"omega": F.lit(OMEGA), "alpha": F.lit(ALPHA), "beta": F.lit(BETA)})
    return G.validity(x, WIDTH, 300).select("series_id", "reasons", "valid")


@query()
def garch_fit(spark, d):
    train = G.split_rows(_returns(spark, d), KEY, "ret_idx").where("is_train")
    return G.garch_fit(train, KEY, "ret_idx")


@query()
def standardised_residuals(spark, d):
    """Test residuals over the fitted conditional deviation, with their ranks against the normal law."""
    rows = G.split_rows(_returns(spark, d), KEY, "ret_idx")
    fit = materialize(G.garch_fit(rows.where("is_train"), KEY, "ret_idx").withColumnsRenamed({"h_last": "h0", "eps_last": "eps0"}), "fit")
    test = rows.where("not is_train").join(fit.drop("n", "loglik"), KEY)
    h = G.conditional_variance(test, KEY, "ret_idx").join(fit.select(*KEY, "mu"), KEY)
    z = h.withColumn("z", (F.col("ret") - F.col("mu")) / F.sqrt("h")).select("series_id", "ret_idx", "z")
    return G.qq_pairs(materialize(z, "residuals"), KEY, "z", "ret_idx")


@query(f"with {_RET}, n as (select series_id, count(*) as n from kept group by series_id) select series_id, ret_idx, row_number() over (partition by series_id order by ret, ret_idx) as rank, round((row_number() over (partition by series_id order by ret, ret_idx) - 0.5) / n, 9) as position from kept join n using (series_id)")
def qq_positions(spark, d):
    x = G.qq_pairs(_returns(spark, d), KEY, "ret", "ret_idx")
    return rounded(x.select("series_id", "ret_idx", F.col("rank").cast("long").alias("rank"), "position"), "position")


@query(f"with recursive {_CHAIN}, f as (select series_id, arg_min(open, bar_idx) as f from gb group by series_id), m as (select series_id, entry_idx as bar_idx, 'long' as type, entry_price as price from tr union all select series_id, exit_idx, 'sell', exit_price from tr union all select series_id, e, 'long', cost from entries where x = 9223372036854775807) select m.series_id, bar_idx, type, price / f * 100 as y from m join f using (series_id)")
def trade_markers(spark, d):
    """Entries and exits on the scale of the first open as 100."""
    bars, book = _book(spark, d, ALWAYS)
    first = bars.groupBy("series_id").agg(F.min_by("open", "bar_idx").alias("_f"))
    return L.transactions(book, RUN).join(first, "series_id").select("series_id", "bar_idx", "type", (F.col("price") / F.col("_f") * 100).alias("y"))


@query(f"{_runs(LEGACY, LONG)} select series_id, param_id, round(avg(max_inc), 6) as mean_max_inc, count(max_inc) as stretches from signals group by all")
def mean_max_increase(spark, d):
    """Mean of the largest rise of each finished or given-up stretch, per run."""
    x = S.run_strategy(good_bars(spark, d), [LEGACY, LONG], "series_id")
    return rounded(x.groupBy(*RUN).agg(F.avg("max_inc").alias("mean_max_inc"), F.count("max_inc").alias("stretches")), "mean_max_inc", n=6)


@query("select file_id, count(*) as lines from tick_line group by file_id")
def line_counts(spark, d):
    return table(spark, d, "tick_line").groupBy("file_id").agg(F.count("*").alias("lines"))


@query(f"with recursive {_GARCH}, w as (select series_id, min(ret_idx) as a, max(ret_idx) as b from ev group by series_id) select kept.series_id, kept.ret_idx, kept.ts, round(sqrt(ev.sigma2_hat), 9) as vol_hat from kept join w on w.series_id = kept.series_id and kept.ret_idx between a and b left join ev on ev.series_id = kept.series_id and ev.ret_idx = kept.ret_idx")
def garch_overview(spark, d):
    """Evaluated values laid over the bars of their window."""
    ev = materialize(_evaluated(spark, d).select("series_id", "ret_idx", F.sqrt("sigma2_hat").alias("vol_hat")), "evaluated")
    window = ev.groupBy("series_id").agg(F.min("ret_idx").alias("_a"), F.max("ret_idx").alias("_b"))
    x = _returns(spark, d).join(window, "series_id").where("ret_idx between _a and _b").join(ev, ["series_id", "ret_idx"], "left")
    return rounded(x.select("series_id", "ret_idx", "ts", "vol_hat"), "vol_hat")


@query()
def garch_validation(spark, d):
    """Fit, forecast and verdict for every series, an hour ahead."""
    seconds = Q.all_period(I.time_deltas(clean_bars(spark, d), KEY), KEY)
    return G.validate_forecast(_returns(spark, d), KEY, "ret_idx", WIDTH, seconds)[1]


# --- files and streams ----------------------------------------------------------------------------------------------------


@query(_FILLED.replace("select symbol, ts, coalesce(open, c) as open, coalesce(high, c) as high, coalesce(low, c) as low, c as close, case when there then volume else 0.0 end as volume from f", "select count(*) as bars, min(ts) as first_ts, max(ts) as last_ts, round(avg(coalesce(high, c)), 6) as mean_high from f"))
def csv_round_trip(spark, d):
    """Bars written without a header and read back by the readers that must find their layout."""
    from ..sources import files, sinks

    path = f"{work_dir(spark)}/{spark.sparkContext.applicationId}/bars-{uuid.uuid4().hex}"
    bars = B.filled_bars(event_ticks(spark, d), BAR_S).select("ts", "low", "close", "high", "open", "volume")
    sinks.write_all_bars(bars, path)
    return files.read_bars_csv(spark, path).groupBy().agg(F.count("*").alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), r(F.avg("high"), 6).alias("mean_high"))


@query()
def file_catalog_search(spark, d):
    """Catalog of the tables' files, searched as results are."""
    from ..sources import files

    return files.search(files.file_catalog(spark, d, "*.parquet"), "ar").select("name", "token", "folder", "size_kb")


def _streamed(spark, d, name, build):
    """Run a stream over the events file to its end and give the table it filled."""
    e = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    ticks = e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("px"), B.number_in(F.col("props")).alias("vol"))
    out = f"{work_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    q = build(ticks).writeStream.format("parquet").option("path", f"{out}/table").option("checkpointLocation", f"{out}/progress").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/table")


@query(f"with {_TICKS}, {_TBARS} select symbol, bts as ts, open, high, low, close, vol_sum, tick_count from tbars where bts + interval 15 minutes <= (select max(ts) from ticks) - interval 10 minutes")
def stream_bars(spark, d):
    """Bars of the event stream that its watermark has closed."""
    from ..streaming.streams import stream_bars as bars

    return _streamed(spark, d, "stream-bars", lambda t: bars(t, BAR_S)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(f"{_runs(LONG)} select series_id::varchar as symbol, ts, bar_idx, holding_signal, execution, close_type, period from signals")
def stream_strategy_signals(spark, d):
    """Signals of the long machine over a stream of bars, one file of the stream being one step of its time."""
    from ..streaming.streams import stream_strategy

    out = f"{work_dir(spark)}/{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    bars = good_bars(spark, d).select(F.col("series_id").cast("string").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "open", "high", "low", "close")
    bars.write.parquet(f"{out}/bars")
    source = spark.readStream.schema(bars.schema).parquet(f"{out}/bars")
    q = stream_strategy(source, LONG).writeStream.format("parquet").option("path", f"{out}/table").option("checkpointLocation", f"{out}/progress").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/table").select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "bar_idx", "holding_signal", "execution", "close_type", "period")

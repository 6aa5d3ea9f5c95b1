"""Queries of the general training-data problems over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.drift import drift_changes, drift_table
from ..operators.grid import bar_grid, slot_text, tick_grid
from ..operators.multiselect import combine_summaries, day_summaries, multi_select
from ..operators.rejects import load_tick_lines
from ..operators.spikes import flag_bars
from ..operators.timestamps import normalise_timestamps
from ..session import materialize
from ..sources.tables import table

PROBS = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
NAMES = ["p05", "p25", "p50", "p75", "p95", "p99"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return load_tick_lines(table(spark, d, "tick_line")).where("reason is not null").select("line_id", "reason")


def p1_ticks(spark: SparkSession, d: str) -> DataFrame:
    return load_tick_lines(table(spark, d, "tick_line")).where("reason is null").select("line_id", "bid", "ask", "vol")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return drift_changes(table(spark, d, "drift_file"), table(spark, d, "drift_line")).select("file_id", "change_kind", "field_name").distinct()


def p2_table(spark: SparkSession, d: str) -> DataFrame:
    return drift_table(table(spark, d, "drift_file"), table(spark, d, "drift_line"))


def _p3(spark: SparkSession, d: str, impute: bool) -> DataFrame:
    ticks, bars = tick_grid(table(spark, d, "tick"), table(spark, d, "feed"), impute=impute), bar_grid(table(spark, d, "bars"), table(spark, d, "series"), impute=impute)
    return ticks.withColumn("origin", F.lit("tick")).unionByName(bars.withColumn("origin", F.lit("bars")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Periods without a reading of the series as ``p3_series`` gives it, filled by the same rounds."""
    return _p3(spark, d, True).where("missing").select("origin", "source_id", slot_text(F.col("slot_us")).alias("slot"))


def p3_series(spark: SparkSession, d: str) -> DataFrame:
    return _p3(spark, d, True).select("origin", "source_id", slot_text(F.col("slot_us")).alias("slot"), "value", "missing", "filled", "settled")


def p3_bar_gaps(spark: SparkSession, d: str) -> DataFrame:
    bars = bar_grid(table(spark, d, "bars"), table(spark, d, "series"), impute=False)
    return bars.where("missing").select("source_id", slot_text(F.col("slot_us")).alias("slot"))


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Periods of each source, and how many lack a reading."""
    return _p3(spark, d, False).groupBy("origin", "source_id").agg(F.count("*").alias("periods"), F.count_if("missing").alias("missing"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return flag_bars(table(spark, d, "bars")).where("state <> 'normal'").select("bar_id")


def p4_states(spark: SparkSession, d: str) -> DataFrame:
    return flag_bars(table(spark, d, "bars"))


def p4_faults(spark: SparkSession, d: str) -> DataFrame:
    """Bars that the model finds out of range or frozen; what these are can be said in rules as well."""
    return flag_bars(table(spark, d, "bars")).where("state in ('out_of_range', 'stuck')").select("bar_id")


def _signals(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "signal_rrv")
    level = lambda name, key: F.struct(F.lit(name).alias("level"), key.cast("string").alias("key"))
    measure = lambda name: F.struct(F.lit(name).alias("measure"), F.col(name).alias("value"))
    x = s.select("signal_id", F.to_date("bar_date").alias("day"), F.explode(F.array(level("series", F.col("series_id")), level("symbol", F.col("symbol")))).alias("g"), "rrv_up", "rrv_down")
    return x.select("signal_id", "day", "g.*", F.explode(F.array(measure("rrv_up"), measure("rrv_down"))).alias("m")).select("signal_id", "day", "level", "key", "m.*")


def _named(df: DataFrame) -> DataFrame:
    return df.select("level", "key", "measure", F.col("n").cast("long").alias("n"), *[F.col(f"q{i}").alias(n) for i, n in enumerate(NAMES)])


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _named(multi_select(_signals(spark, d), ["level", "key", "measure"], "value", PROBS, "signal_id"))


def p5_combined(spark: SparkSession, d: str) -> DataFrame:
    keys = ["level", "key", "measure"]
    return _named(combine_summaries(day_summaries(_signals(spark, d), keys, "day", "value", "signal_id"), keys, PROBS))


def p5_overall(spark: SparkSession, d: str) -> DataFrame:
    """All symbols together, one group a measure."""
    q = multi_select(_signals(spark, d).where("level = 'series'"), ["measure"], "value", PROBS, "signal_id")
    return q.select("measure", F.col("n").cast("long").alias("n"), *[F.col(f"q{i}").alias(n) for i, n in enumerate(NAMES)])


#: Rank error the days' summaries of ``p5_overall_combined`` are built for, as a share of the rows.
COARSE = 0.05


def p5_overall_combined(spark: SparkSession, d: str) -> DataFrame:
    """``measure, prob, exact``: the exact percentile wherever the one combined from coarse days lies within its rank error."""
    x = _signals(spark, d).where("level = 'series'").where(F.abs("value") < float("inf"))
    combined = combine_summaries(day_summaries(x, ["measure"], "day", "value", "signal_id", COARSE), ["measure"], PROBS)
    pairs = lambda q, name: q.select("measure", "n", F.posexplode(F.array(*[f"q{i}" for i in range(len(PROBS))])).alias("i", name))
    told = materialize(pairs(combined, "told"), "told")
    places = x.join(F.broadcast(told), "measure").groupBy("measure", "i").agg(F.count(F.when(F.col("value") < F.col("told"), 1)).alias("lt"), F.count(F.when(F.col("value") <= F.col("told"), 1)).alias("le"))
    exact = pairs(multi_select(x, ["measure"], "value", PROBS, "signal_id"), "exact").withColumn("prob", F.get(F.array(*map(F.lit, PROBS)), F.col("i")))
    k = F.ceil(F.col("prob") * F.col("n") - 1e-9)
    within = F.greatest(F.col("lt") + 1 - k, k - F.col("le")) <= F.ceil(F.col("n") * COARSE)
    return exact.join(places, ["measure", "i"]).select("measure", "prob", F.when(within, F.col("exact")).alias("exact"))


def _instants(spark: SparkSession, d: str) -> DataFrame:
    feeds = table(spark, d, "feed")
    ticks = normalise_timestamps(table(spark, d, "tick"), feeds, "tick_id", "dt").withColumn("origin", F.lit("tick"))
    klines = normalise_timestamps(table(spark, d, "kline"), feeds, "kline_id", "datetime").withColumn("origin", F.lit("kline"))
    return ticks.unionByName(klines)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _instants(spark, d).where("utc_us is not null").select("origin", "row_id", "utc_us")


def p6_status(spark: SparkSession, d: str) -> DataFrame:
    return _instants(spark, d).groupBy("origin", "source", "status").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (p1_found, p1_ticks, p2_found, p2_table, p3_found, p3_series, p3_bar_gaps, p3_coverage, p4_found, p4_states, p4_faults, p5_percentiles, p5_combined, p5_overall, p5_overall_combined, p6_found, p6_status)}

_P1 = r"""
with sep as (
  select file_id, sum((length(coalesce(line,'')) - length(replace(coalesce(line,''), chr(9), '')) = 3)::int) > sum((length(coalesce(line,'')) - length(replace(coalesce(line,''), ',', '')) = 3)::int) as tab
  from tick_line group by file_id
), x as (
  select line_id, tab, regexp_replace(coalesce(line, ''), '[\r\n]+$', '') as s from tick_line join sep using (file_id)
), y as (
  select line_id,
    case when tab then regexp_full_match(s, '( *"[^"]*" *|[^"\t]*)(\t( *"[^"]*" *|[^"\t]*))*') else regexp_full_match(s, '([ \t]*"[^"]*"[ \t]*|[^",]*)(,([ \t]*"[^"]*"[ \t]*|[^",]*))*') end as quoted,
    case when tab then regexp_extract(s, '^( *"[^"]*" *|[^"\t]*)\t( *"[^"]*" *|[^"\t]*)\t( *"[^"]*" *|[^"\t]*)\t( *"[^"]*" *|[^"\t]*)$', ['dt','bid','ask','vol'])
      else regexp_extract(s, '^([ \t]*"[^"]*"[ \t]*|[^",]*),([ \t]*"[^"]*"[ \t]*|[^",]*),([ \t]*"[^"]*"[ \t]*|[^",]*),([ \t]*"[^"]*"[ \t]*|[^",]*)$', ['dt','bid','ask','vol']) end as f,
    case when tab then regexp_matches(s, '^( *"[^"]*" *|[^"\t]*)\t( *"[^"]*" *|[^"\t]*)\t( *"[^"]*" *|[^"\t]*)\t( *"[^"]*" *|[^"\t]*)$')
      else regexp_matches(s, '^([ \t]*"[^"]*"[ \t]*|[^",]*),([ \t]*"[^"]*"[ \t]*|[^",]*),([ \t]*"[^"]*"[ \t]*|[^",]*),([ \t]*"[^"]*"[ \t]*|[^",]*)$') end as four
  from x
), z as (
  select line_id, quoted, four, trim(trim(trim(f.bid, chr(32)||chr(9)), '"'), chr(32)||chr(9)) as bid, trim(trim(trim(f.ask, chr(32)||chr(9)), '"'), chr(32)||chr(9)) as ask, trim(trim(trim(f.vol, chr(32)||chr(9)), '"'), chr(32)||chr(9)) as vol from y
), n as (
  select *, case when regexp_full_match(bid, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') then try_cast(bid as double) end as b,
    case when regexp_full_match(ask, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') then try_cast(ask as double) end as a,
    case when regexp_full_match(vol, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') then try_cast(vol as double) end as v from z
), j as (
  select line_id, b, a, v, case when not quoted then 'quoting' when not four then 'columns' when b is null or not b > 0 or isinf(b) then 'bid' when a is null or not a > 0 or isinf(a) then 'ask'
    when vol <> '' and (v is null or v < 0 or isinf(v)) then 'vol' end as reason from n
)
"""

_GAPS = """
with slots as (
  select series_id, period_s, time_bucket(to_seconds(period_s), time, date_trunc('day', time)) as slot, volume
  from bars join (select series_id, max(period_s) as period_s from series group by series_id) using (series_id)
), span as (select series_id, period_s, min(slot) as a, max(slot) as b from slots group by all),
sessions as (select distinct series_id, cast(slot + interval 6 hours as date) as session from slots),
grid as (
  select series_id, unnest(generate_series(greatest(a, session - interval 6 hours), least(b, session + interval 18 hours - to_seconds(period_s)), to_seconds(period_s))) as slot
  from sessions join span using (series_id)
)
-- missing
select distinct g.series_id as source_id, strftime(g.slot, '%Y-%m-%d %H:%M:%S') as slot from grid g
where hour(g.slot) <> 17 and not exists (select 1 from slots s where s.series_id = g.series_id and s.slot = g.slot and s.volume is not null)
"""

_PERCENTILES = f"""
with x as (
  select level, key, measure, value from (
    select 'series' as level, cast(series_id as varchar) as key, 'rrv_up' as measure, rrv_up as value from signal_rrv
    union all select 'series', cast(series_id as varchar), 'rrv_down', rrv_down from signal_rrv
    union all select 'symbol', symbol, 'rrv_up', rrv_up from signal_rrv
    union all select 'symbol', symbol, 'rrv_down', rrv_down from signal_rrv)
  where isfinite(value)
), q as (select level, key, measure, count(*) as n, quantile_disc(value, {PROBS}) as q from x group by level, key, measure)
select level, key, measure, n, {", ".join(f"q[{i + 1}] as {n}" for i, n in enumerate(NAMES))} from q
"""

_INSTANTS = r"""
zones(tz_name, abbr, off) as (values ('America/New_York', 'EST', -5.0), ('America/New_York', 'EDT', -4.0), ('America/Chicago', 'CST', -6.0), ('America/Chicago', 'CDT', -5.0), ('Europe/London', 'GMT', 0.0), ('Europe/London', 'BST', 1.0),
  ('Europe/Berlin', 'CET', 1.0), ('Europe/Berlin', 'CEST', 2.0), ('Asia/Tokyo', 'JST', 9.0), ('Asia/Kolkata', 'IST', 5.5), ('Australia/Sydney', 'AEST', 10.0), ('Australia/Sydney', 'AEDT', 11.0)),
raw as (select 'tick' as origin, tick_id as row_id, feed_id, file_id, bid, dt as s from tick union all select 'kline', kline_id, feed_id, null, null, datetime from kline),
txt as (select raw.* exclude (s), trim(s, ' ' || chr(9) || chr(10) || chr(13)) as s, tz_name, date_style from raw left join feed using (feed_id)),
p as (select *,
  regexp_extract(s, '^(\d{4})-(\d{1,2})-(\d{1,2})[T ](\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?(Z|[+-]\d{2}:?\d{2})?$', ['y', 'mo', 'd', 'h', 'mi', 'se', 'f', 'z']) as iso,
  regexp_extract(s, '^(\d{4})(\d{2})(\d{2}) (\d{2})(\d{2})(\d{2})(\d{3})?$', ['y', 'mo', 'd', 'h', 'mi', 'se', 'f']) as com,
  regexp_extract(s, '^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}):(\d{2})(?::(\d{2}))?(?: ([AP])M)?$', ['a', 'b', 'y', 'h', 'mi', 'se', 'half']) as sla,
  regexp_extract(s, '^(\d{1,2}) ([A-Za-z]{3}) (\d{4}) (\d{1,2}):(\d{2}):(\d{2}) ([A-Z]{2,5})$', ['d', 'mon', 'y', 'h', 'mi', 'se', 'z']) as nam from txt),
q as (select origin, row_id, feed_id, file_id, bid, tz_name, s,
  case when iso.y <> '' then iso.z when nam.y <> '' then nam.z else '' end as z,
  case when iso.y <> '' then iso.y when com.y <> '' then com.y when sla.y <> '' then sla.y when nam.y <> '' then nam.y end as y,
  case when iso.y <> '' then iso.mo when com.y <> '' then com.mo when sla.y <> '' then case when date_style = 'mdy' then sla.a else sla.b end when nam.y <> '' then try_cast(list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(nam.mon)) as varchar) end as mo,
  case when iso.y <> '' then iso.d when com.y <> '' then com.d when sla.y <> '' then case when date_style = 'mdy' then sla.b else sla.a end when nam.y <> '' then nam.d end as d,
  case when iso.y <> '' then iso.h when com.y <> '' then com.h when sla.y <> '' then case when sla.half = '' then sla.h when try_cast(sla.h as int) not between 1 and 12 then '99' else try_cast(try_cast(sla.h as int) % 12 + case when sla.half = 'P' then 12 else 0 end as varchar) end when nam.y <> '' then nam.h end as h,
  case when iso.y <> '' then iso.mi when com.y <> '' then com.mi when sla.y <> '' then sla.mi when nam.y <> '' then nam.mi end as mi,
  case when iso.y <> '' then iso.se when com.y <> '' then com.se when sla.y <> '' then sla.se when nam.y <> '' then nam.se end as se,
  case when iso.y <> '' then iso.f when com.y <> '' then com.f else '' end as f from p),
l as (select *, case when try_cast(h as int) <= 23 and try_cast(mi as int) <= 59 and coalesce(try_cast(se as int), 0) <= 59 then try_cast(y || '-' || lpad(mo, 2, '0') || '-' || lpad(d, 2, '0') || ' ' || lpad(h, 2, '0') || ':' || mi || ':' || case when se = '' then '00' else se end || '.' || rpad(substr(f, 1, 6), 6, '0') as timestamp) end as t from q),
o as (select l.*, case when l.z in ('Z', 'UTC', 'GMT') then 0 when regexp_matches(l.z, '^[+-]') then try_cast(substr(l.z, 1, 1) || '1' as int) * (try_cast(substr(replace(l.z, ':', ''), 2, 2) as int) * 3600 + try_cast(substr(replace(l.z, ':', ''), 4, 2) as int) * 60) when l.z <> '' and regexp_matches(l.tz_name, '^[+-]') then try_cast(substr(l.tz_name, 1, 1) || '1' as int) * (try_cast(substr(l.tz_name, 2, 2) as int) * 3600 + try_cast(substr(l.tz_name, 5, 2) as int) * 60) when l.z <> '' then try_cast(zones.off * 3600 as int)
    when l.tz_name = 'UTC' then 0 when regexp_matches(l.tz_name, '^[+-]') then try_cast(substr(l.tz_name, 1, 1) || '1' as int) * (try_cast(substr(l.tz_name, 2, 2) as int) * 3600 + try_cast(substr(l.tz_name, 5, 2) as int) * 60) end as off
  from l left join zones on zones.tz_name = l.tz_name and zones.abbr = l.z),
u as (select *, case when off is null and z = '' and t is not null and tz_name is not null then epoch_us(timezone(tz_name, t)) end as v from o),
w as (select *, [x for x in [v - 7200000000, v - 3600000000, v, v + 3600000000, v + 7200000000] if timezone(tz_name, make_timestamptz(x)) = t] as found from u),
inst as (select origin, row_id, file_id, bid, case when regexp_full_match(s, '\d{10}') then try_cast(s as bigint) * 1000000 when regexp_full_match(s, '\d{13}') then try_cast(s as bigint) * 1000 when regexp_full_match(s, '\d{16}') then try_cast(s as bigint)
  when off is not null then epoch_us(t) - off::bigint * 1000000 when v is not null and len(found) = 1 then found[1] end as utc_us from w)
"""

_MINUTES = """m as (select file_id, utc_us // 60000000 as slot from inst where origin = 'tick' and utc_us is not null and bid > 0 and file_id is not null),
sp as (select file_id, min(slot) as a, max(slot) as b from m group by file_id), g as (select file_id, unnest(generate_series(a, b)) as slot from sp)
select 'tick' as origin, g.file_id as source_id, strftime(make_timestamp(g.slot * 60000000), '%Y-%m-%d %H:%M:%S') as slot from g left join (select distinct file_id, slot from m) h on h.file_id = g.file_id and h.slot = g.slot where h.slot is null"""

_COMBINED = f"""
with x as (
  select 'series' as level, cast(series_id as varchar) as key, 'rrv_up' as measure, cast(bar_date as date) as day, rrv_up as value from signal_rrv union all select 'series', cast(series_id as varchar), 'rrv_down', cast(bar_date as date), rrv_down from signal_rrv
  union all select 'symbol', symbol, 'rrv_up', cast(bar_date as date), rrv_up from signal_rrv union all select 'symbol', symbol, 'rrv_down', cast(bar_date as date), rrv_down from signal_rrv
), r as (select *, row_number() over (partition by level, key, measure, day order by value) - 1 as rn, count(*) over (partition by level, key, measure, day) as n from x where isfinite(value)),
s as (select *, cast(greatest(1, floor(n * 0.01)) as bigint) as step from r), k as (select *, rn // step as i from s),
z as (select level, key, measure, value, least(step, n - i * step) as w from k where rn = i * step + (least(step, n - i * step) - 1) // 2),
c as (select *, sum(w) over (partition by level, key, measure order by value rows unbounded preceding) as cum, sum(w) over (partition by level, key, measure) as total from z)
select level, key, measure, cast(max(total) as bigint) as n, {", ".join(f"min(value) filter (where cum >= greatest(ceil({p} * total - 1e-9), 1)) as {n}" for p, n in zip(PROBS, NAMES))} from c group by level, key, measure
"""

_COVERAGE = f"""with {_INSTANTS}, gaps as ({_GAPS}), ticks_missing as (with {_MINUTES}), {_GAPS[_GAPS.index("slots as") : _GAPS.index("-- missing")]},
bar_periods as (select series_id as source_id, count(distinct slot) as periods from grid where hour(slot) <> 17 group by series_id),
tick_periods as (select file_id as source_id, max(utc_us // 60000000) - min(utc_us // 60000000) + 1 as periods from inst where origin = 'tick' and utc_us is not null and bid > 0 and file_id is not null group by file_id)
select 'bars' as origin, p.source_id, p.periods, count(g.slot) as missing from bar_periods p left join gaps g on g.source_id = p.source_id group by all
union all select 'tick', p.source_id, p.periods, count(t.slot) from tick_periods p left join ticks_missing t on t.source_id = p.source_id group by all"""

_FAULTS = """
with x as (select min(bar_id) as bar_id, series_id, time, open, high, low, close, volume from bars group by series_id, time, open, high, low, close, volume),
y as (select *, open <= 0 or high <= 0 or low <= 0 or close <= 0 or low > high or open > high or open < low or close > high or close < low as hard,
  coalesce(volume > 0 and open = lag(open) over w and high = lag(high) over w and low = lag(low) over w and close = lag(close) over w, false) as again from x window w as (partition by series_id order by time nulls first, bar_id)),
z as (select *, sum((not again)::int) over (partition by series_id order by time nulls first, bar_id rows unbounded preceding) as run from y),
f as (select *, again and sum(again::int) over (partition by series_id, run) >= 5 as stuck from z)
select b.bar_id from bars b join f on b.series_id is not distinct from f.series_id and b.time is not distinct from f.time and b.open is not distinct from f.open and b.high is not distinct from f.high
  and b.low is not distinct from f.low and b.close is not distinct from f.close and b.volume is not distinct from f.volume where coalesce(f.hard, false) or f.stuck"""

_OVERALL = f"""x as (select 'rrv_up' as measure, rrv_up as value from signal_rrv union all select 'rrv_down', rrv_down from signal_rrv),
q as (select measure, count(*) as n, quantile_disc(value, {PROBS}) as q from x where isfinite(value) group by measure)"""

SQL = {
    "p3_coverage": _COVERAGE,
    "p4_faults": _FAULTS,
    "p5_overall": f"with {_OVERALL} select measure, n, {', '.join(f'q[{i + 1}] as {n}' for i, n in enumerate(NAMES))} from q",
    "p5_overall_combined": f"with {_OVERALL} select measure, unnest({PROBS}::double[]) as prob, unnest(q) as exact from q",
    "p1_found": _P1 + "select line_id, reason from j where reason is not null",
    "p1_ticks": _P1 + "select line_id, b as bid, a as ask, v as vol from j where reason is null",
    "p3_bar_gaps": _GAPS,
    "p3_found": f"with {_INSTANTS}, ticks_missing as (with {_MINUTES}), bars_missing as ({_GAPS}) select origin, source_id, slot from ticks_missing union all select 'bars', source_id, slot from bars_missing",
    "p6_found": f"with {_INSTANTS} select origin, row_id, utc_us from inst where utc_us is not null",
    "p6_status": f"""with {_INSTANTS}, st as (select origin, feed_id as source, case when regexp_full_match(s, '\\d{{10}}|\\d{{13}}|\\d{{16}}') or (off is not null and t is not null) or (v is not null and len(found) = 1) then 'ok'
      when t is null then 'unreadable' when z <> '' then 'unknown_abbreviation' when tz_name is null then 'no_zone' when len(found) = 0 then 'skipped' else 'twice' end as status from w)
      select origin, source, status, count(*) as n from st group by all""",
    "p5_combined": _COMBINED,
    "p5_percentiles": _PERCENTILES,
}

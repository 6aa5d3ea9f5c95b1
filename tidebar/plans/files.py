"""Queries that write files in the shapes results and feeds have, and read them back, and an own strategy on the engine."""

from __future__ import annotations

import io
import os
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as B
from ..operators import engine as E
from ..session import work_dir
from ..sources import files, sinks
from ..sources.tables import table
from .reference import _GB, good_bars, rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _at(column: str, form: str):
    return F.date_format(F.col(column), form)


@query("select strftime(time, '%Y-%m-%d %H:%M:%S')::timestamp as datetime, open, high, low, close, volume from bars where time is not null and close > 0")
def kline_file_round_trip(spark, d):
    """Bars as files with a header in mixed case between semicolons, read by the reader that must find both."""
    path = _folder(spark, "klines")
    b = table(spark, d, "bars")
    names = {"DateTime": _at("time", "yyyy-MM-dd HH:mm:ss"), " Open": F.col("open"), "HIGH ": F.col("high"), "low": F.col("low"), "Close": F.col("close"), "VOLUME": F.col("volume")}
    b.select(*[c.cast("string").alias(n) for n, c in names.items()]).write.csv(path, header=True, sep=";")
    return files.read_kline_csv(spark, path)


@query("""select case when series_id % 2 = 0 then 'five' else 'four' end as layout, strftime(time, '%Y%m%d %H%M%S') || lpad((millisecond(time) % 1000)::varchar, 3, '0') as dt, open as bid, close as ask, volume as vol
from bars where time is not null and series_id is not null""")
def tick_file_round_trip(spark, d):
    """Files of four and of five columns in one place, told apart by the vote over their rows and laid over one another."""
    path = _folder(spark, "ticks")
    b = table(spark, d, "bars").where("time is not null and series_id is not null")
    day, clock = _at("time", "yyyyMMdd"), _at("time", "HHmmssSSS")
    b.where("series_id % 2 = 0").select(day.alias("d"), clock.alias("t"), "open", "close", "volume").write.csv(f"{path}/five", header=False)
    b.where("series_id % 2 <> 0").select(F.concat(day, F.lit(" "), clock).alias("dt"), "open", "close", "volume").write.csv(f"{path}/four", header=False)
    x = files.read_ticks_csv(spark, f"{path}/*", ",")
    layout = F.regexp_extract("file", "/(five|four)/[^/]*$", 1)
    return x.select(layout.alias("layout"), "dt", *[F.col(c).try_cast("double").alias(c) for c in ("bid", "ask", "vol")])


ARCHIVES = 16


@query(f"select file_id % {ARCHIVES} as archive, 'DAT_ASCII_ticks.csv' as member, count(*) as lines, sum(length(regexp_replace(coalesce(line, ''), '[\\r\\n]+$', '')))::bigint as chars from tick_line where file_id is not null group by all")
def zip_round_trip(spark, d):
    """Raw lines packed into archives with another text beside them, and read from the member that counts."""
    path = _folder(spark, "zips")

    def pack(pdf):
        import pandas as pd

        os.makedirs(path, exist_ok=True)
        number = int(pdf["archive"].iloc[0])
        memory = io.BytesIO()
        with zipfile.ZipFile(memory, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("a_note.txt", "not this one\n")
            z.writestr("DAT_ASCII_ticks.csv", "\n".join((x or "").rstrip("\r\n") for x in pdf["line"]) + "\n")
        # a lost task is done again, so the archive appears whole or not at all
        part = f"{path}/.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(memory.getvalue())
        os.replace(part, f"{path}/ticks_{number}.zip")
        return pd.DataFrame({"archive": [number]})

    x = table(spark, d, "tick_line").where("file_id is not null").select((F.col("file_id") % ARCHIVES).alias("archive"), "line")
    x.groupBy("archive").applyInPandas(pack, "archive long").count()
    lines = files.read_zipped_lines(spark, path)
    archive = F.regexp_extract("file", r"ticks_(\d+)\.zip$", 1).cast("long")
    return lines.groupBy(archive.alias("archive"), "member").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"))


_PAGES = """pages as (select n_name || '_of_' || n_nationkey || '.html' as name, r_name as folder, n_nationkey as k from nation join region on n_regionkey = r_regionkey),
shown as (select *, folder || '/' || name as token, replace(regexp_replace(name, '\\.html$', ''), '_', ' ') as display from pages)"""


@query(f"with {_PAGES} select name, display, token, folder, round((k + 1) * 100 / 1024, 1) as size_kb, to_json({{'name': name, 'folder': folder}}) as json from shown where lower(name) like '%i%' or lower(display) like '%i%' or lower(folder) like '%i%'")
def catalog_search(spark, d):
    """Pages of results below a folder, listed and searched; the same as JSON for a browser."""
    path = _folder(spark, "pages")

    def write(frames):
        for f in frames:
            for folder, name, k in zip(f["folder"], f["name"], f["k"]):
                os.makedirs(f"{path}/{folder}", exist_ok=True)
                with open(f"{path}/{folder}/{name}", "w") as page:
                    page.write("x" * (100 * (k + 1)))
            yield f[["k"]]

    n, r = table(spark, d, "nation"), table(spark, d, "region")
    pages = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(F.concat("n_name", F.lit("_of_"), "n_nationkey", F.lit(".html")).alias("name"), F.col("r_name").alias("folder"), F.col("n_nationkey").cast("long").alias("k"))
    pages.mapInPandas(write, "k long").count()
    found = files.search(files.file_catalog(spark, path), " I ")
    return found.select("name", "display", "token", "folder", "size_kb", F.to_json(F.struct("name", "folder")).alias("json"))


@query("""select n_name || t as token, safe from nation cross join (values ('.html', true), ('%20x.HTML', true), ('.txt', false), ('%2F..%2Fup.html', false), ('/../up.html', false)) v(t, safe)
union all select p || n_name || '.html', false from nation cross join (values ('/'), ('../'), ('%2F')) w(p)""")
def safe_paths(spark, d):
    """Which paths a browser may ask for."""
    n = table(spark, d, "nation").select("n_name")
    before = n.select(F.explode(F.array(*[F.concat("n_name", F.lit(t)) for t in (".html", "%20x.HTML", ".txt", "%2F..%2Fup.html", "/../up.html")], *[F.concat(F.lit(p), "n_name", F.lit(".html")) for p in ("/", "../", "%2F")])).alias("token"))
    return before.select("token", files.safe_path(F.col("token")).alias("safe"))


@query("select strftime(time, '%Y-%m') as month, count(*) as bars, round(sum(volume), 6) as volume, min(strftime(time, '%Y-%m-%d %H:%M:%S')) as first from bars where time is not null group by all")
def monthly_round_trip(spark, d):
    """Bars as one headerless file set a month."""
    path = _folder(spark, "months")
    sinks.write_monthly_bars(table(spark, d, "bars").where("time is not null").select(F.col("time").alias("ts"), "open", "high", "low", "close", "volume"), path)
    x = spark.read.schema("ts string, open double, high double, low double, close double, volume double, month string").csv(path)
    return x.groupBy("month").agg(F.count("*").alias("bars"), F.round(F.sum("volume"), 6).alias("volume"), F.min("ts").alias("first"))


@query("""with t as (select symbol, time + interval 5 hours as ts, bar_id, (open + close) / 2 as px from bars where time is not null and open is not null and close is not null and symbol is not null)
select symbol, time_bucket(interval 1 hour, ts) as ts, arg_min(px, (ts, bar_id)) as open, max(px) as high, min(px) as low, arg_max(px, (ts, bar_id)) as close, count(*) as ticks from t group by all""")
def utc_bars(spark, d):
    """Hourly bars in UTC of prices on the fixed New York winter clock."""
    x = table(spark, d, "bars").where("time is not null and open is not null and close is not null and symbol is not null")
    ticks = x.select("symbol", B.fixed_to_utc(F.col("time").cast("timestamp_ntz")).alias("ts"), F.col("bar_id").alias("seq"), ((F.col("open") + F.col("close")) / 2).alias("px"), F.lit(None).cast("double").alias("vol"))
    return B.tick_bars(ticks, 3600).select("symbol", "ts", "open", "high", "low", "close", F.col("tick_count").alias("ticks"))


class Breakout(E.Strategy):
    """Enters on a rising bar at the higher of close and mid, leaves on a fall below its stop or after some bars."""

    @classmethod
    def columns(cls) -> str:
        return "gain double, done long, held_for long"

    @classmethod
    def defaults(cls) -> dict:
        return {"held_for": 0}

    def __init__(self, params: dict):
        super().__init__(params)
        self.price, self.since, self.done = 0.0, 0, 0

    def flat(self, bar: E.Bar) -> E.Entry | None:
        return E.Entry(bar.close) if bar.close > bar.open else None

    def fill(self, bar: E.Bar, entry: E.Entry) -> float:
        return max(entry.price, (bar.high + bar.low) / 2)

    def opened(self, bar: E.Bar, price: float) -> None:
        self.price, self.since = price, bar.index

    def held(self, bar: E.Bar) -> E.Exit | None:
        stop = self.price * (1 - self.params["stop"])
        if bar.low < stop:
            return E.Exit(stop, 1)
        return E.Exit(bar.close, 2) if bar.index - self.since >= self.params["bars"] else None

    def report(self, bar: E.Bar, done: E.Exit) -> None:
        bar.out["gain"] = done.price / self.price

    def closed(self, bar: E.Bar, done: E.Exit) -> None:
        bar.out["held_for"], self.done = bar.index - self.since, self.done + 1

    def record(self, bar: E.Bar) -> None:
        bar.out["done"] = self.done


BREAKOUT = [{"stop": 0.0005, "bars": 5}, {"stop": 0.002, "bars": 12}]
_BREAKOUT = f"""with recursive {_GB}, sets(param_id, stop, bars) as (values {", ".join(f"({i}::bigint, {p['stop']!r}::double, {p['bars']}::bigint)" for i, p in enumerate(BREAKOUT))}),
e(series_id, param_id, i, holding, price, since, done, have_holding, holding_signal, execution, close_type, gain, held_for) as (
  select distinct series_id, param_id, -1::bigint, false, 0.0::double, 0::bigint, 0::bigint, 0, 0, null::double, null::int, null::double, 0::bigint from gb cross join sets
  union all select series_id, param_id, i, case when holding then kind is null else enters end, case when enters then fill else price end, case when enters then i else since end, done + (kind is not null)::bigint,
    holding::int, case when enters then 1 when holding and kind is null then 3 else 0 end, case when enters then fill when kind = 1 then level when kind = 2 then close end, kind, case when kind = 1 then level / price when kind = 2 then close / price end, case when kind is not null then i - since else 0 end
  from (select *, not holding and close > open as enters, greatest(close, (high + low) / 2) as fill, case when holding then case when low < level then 1 when i - since >= bars then 2 end end as kind
    from (select e.series_id, e.param_id, e.i + 1 as i, holding, price, since, done, price * (1 - stop) as level, sets.bars, gb.open, gb.high, gb.low, gb.close from e join sets on sets.param_id = e.param_id join gb on gb.series_id = e.series_id and gb.bar_idx = e.i + 1)))
select e.series_id, param_id, i as bar_idx, gb.ts, gb.close, have_holding, holding_signal, execution, close_type, round(gain, 9) as gain, done, held_for from e join gb on gb.series_id = e.series_id and gb.bar_idx = e.i"""


@query(_BREAKOUT)
def own_strategy(spark: SparkSession, d: str) -> DataFrame:
    """A strategy of a user's own on the engine's callbacks, for two parameter sets."""
    return rounded(E.run(good_bars(spark, d), Breakout, BREAKOUT, Breakout.columns(), "series_id"), "gain")

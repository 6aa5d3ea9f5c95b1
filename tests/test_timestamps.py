"""Instants against a slow reader built on the standard library."""

import re
from collections import Counter
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidebar.functions.timetext import zone_abbreviations
from tidebar.operators.timestamps import date_orders, mixture, normalise_timestamps

EPOCH = datetime(1970, 1, 1)
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def us(t):
    return (t - EPOCH) // timedelta(microseconds=1)


def slow(text, tz, style):
    s = (text or "").strip(" \t\r\n")
    if re.fullmatch(r"\d{10}", s):
        return int(s) * 10**6
    if re.fullmatch(r"\d{13}", s):
        return int(s) * 1000
    if re.fullmatch(r"\d{16}", s):
        return int(s)
    m = re.fullmatch(r"(\d{4})(\d\d)(\d\d) (\d\d)(\d\d)(\d\d)(\d{3})?", s)
    zone = half = None
    if m:
        y, mo, d, h, mi, sec, f = m.groups()
        f = (f or "").ljust(6, "0")
    elif m := re.fullmatch(r"(\d{4})-(\d+)-(\d+)[T ](\d+):(\d\d)(?::(\d\d)(?:\.(\d+))?)?(Z|[+-]\d\d:?\d\d)?", s):
        y, mo, d, h, mi, sec, f, zone = m.groups()
    elif m := re.fullmatch(r"(\d+)/(\d+)/(\d{4}) (\d+):(\d\d)(?::(\d\d))?(?: ([AP])M)?", s):
        a, b, y, h, mi, sec, half = m.groups()
        mo, d = (a, b) if style == "mdy" else (b, a)
        f = ""
    elif m := re.fullmatch(r"(\d+) ([A-Za-z]{3}) (\d{4}) (\d+):(\d\d):(\d\d) ([A-Z]+)", s):
        d, mo, y, h, mi, sec, zone = m.groups()
        mo, f = MONTHS.index(mo.lower()) + 1, ""
    else:
        return None
    h = int(h)
    if half:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if half == "P" else 0)
    try:
        t = datetime(int(y), int(mo), int(d), h, int(mi), int(sec or 0), int((f or "").ljust(6, "0")[:6]))
    except ValueError:
        return None
    if zone in ("Z", "UTC", "GMT"):
        return us(t)
    if zone and zone[0] in "+-":
        z = zone.replace(":", "")
        return us(t) - (1 if z[0] == "+" else -1) * (int(z[1:3]) * 60 + int(z[3:])) * 60 * 10**6
    if tz is None:
        return None
    fixed = re.fullmatch(r"([+-])(\d\d):(\d\d)", tz)
    if fixed:
        off = (1 if fixed[1] == "+" else -1) * (int(fixed[2]) * 60 + int(fixed[3])) * 60 * 10**6
        return us(t) - off
    z = ZoneInfo(tz)
    if zone:
        found = {(t - o).replace(tzinfo=timezone.utc) for o in {t.replace(tzinfo=z, fold=k).utcoffset() for k in (0, 1)} | {timedelta(microseconds=off) for k, v in zone_abbreviations(tz).items() if k == zone for _, _, off in v}}
        found = {x for x in found if x.astimezone(z).tzname() == zone and x.astimezone(z).replace(tzinfo=None) == t}
    else:
        found = {(t - t.replace(tzinfo=z, fold=k).utcoffset()).replace(tzinfo=timezone.utc) for k in (0, 1)}
        found = {x for x in found if x.astimezone(z).replace(tzinfo=None) == t}
    return us(found.pop().replace(tzinfo=None)) if len(found) == 1 else None


def test_matches_slow_reader(spark, small):
    feeds = spark.read.parquet(f"{small}/feed.parquet")
    known = {r.feed_id: (r.tz_name, r.date_style) for r in feeds.collect()}
    for name, row_id, col in (("tick", "tick_id", "dt"), ("kline", "kline_id", "datetime")):
        df = spark.read.parquet(f"{small}/{name}.parquet")
        got = {r.row_id: r.utc_us for r in normalise_timestamps(df, feeds, row_id, col).collect()}
        rows = df.select(row_id, col, "feed_id").collect()
        assert len(got) == len(rows)
        wrong = [(r[1], known[r[2]], got[r[0]], w) for r in rows if got[r[0]] != (w := slow(r[1], *known[r[2]]))]
        assert not wrong, wrong[:5]


def run(spark, rows, feeds):
    df = spark.createDataFrame(rows, "id long, feed long, t string, status string, kind int, zone string").withColumnRenamed("feed", "feed_id")
    f = spark.createDataFrame(feeds, "feed_id long, tz_name string, date_style string")
    return {r.row_id: (r.utc_us, r.status) for r in normalise_timestamps(df, f, "id", "t").collect()}


def test_edges(spark):
    texts = ["2025-03-09 02:30:00", "2025-11-02 01:30:00", "02 Nov 2025 01:30:00 EDT", "02 Nov 2025 01:30:00 EST", "2024-02-30 10:00:00", "2024-02-29 10:00:00", "2025-01-01 24:00:00", "2025-01-01 10:60:00", "13/25/2025 10:00", "03/04/2025 12:00:00 AM", "03/04/2025 13:00:00 PM", None, "", "  ", "x" * 100_000, "20250101 180005123", "2025-06-01T10:00:00+05:30", "01 Jan 2025 10:00:00 XYZ"]
    got = run(spark, [(i, 1, t, "s", 1, "z") for i, t in enumerate(texts)], [(1, "America/New_York", "mdy")])
    s = [got[i][1] for i in range(len(texts))]
    assert s[:9] == ["skipped", "twice", "ok", "ok", "unreadable", "ok", "unreadable", "unreadable", "unreadable"]
    assert got[3][0] - got[2][0] == 3600 * 10**6
    assert s[9:] == ["ok", "unreadable", "unreadable", "unreadable", "unreadable", "unreadable", "ok", "ok", "unknown_abbreviation"]
    assert got[16][0] == us(datetime(2025, 6, 1, 4, 30))


def test_undeclared_style_by_mixture(spark):
    day_first = [(i, 1, f"{13 + i % 15}/0{1 + i % 9}/2025 10:00", None, None, None) for i in range(40)] + [(100, 1, "03/04/2025 10:00", None, None, None)]
    even = [(200, 2, "13/04/2025 10:00", None, None, None), (201, 2, "04/13/2025 10:00", None, None, None), (202, 2, "03/04/2025 10:00", None, None, None), (203, 2, "05/05/2025 10:00", None, None, None)]
    got = run(spark, day_first + even, [(1, "UTC", None), (2, "UTC", None)])
    assert got[100] == (us(datetime(2025, 4, 3, 10)), "ok")
    assert got[202] == (None, "ambiguous") and got[203][1] == "ok" and got[200][1] == got[201][1] == "ok"


def test_orders_are_recovered_without_declared_styles(spark, small):
    """With ``date_style`` taken away every feed with enough dates of one order gets the instants it had with it."""
    feeds = spark.read.parquet(f"{small}/feed.parquet")
    tick = spark.read.parquet(f"{small.replace('0.001', '0.01')}/tick.parquet")
    told = {r.row_id: (r.utc_us, r.source) for r in normalise_timestamps(tick, feeds, "tick_id", "dt").collect()}
    bare = normalise_timestamps(tick, feeds.withColumn("date_style", F.lit(None).cast("string")), "tick_id", "dt").collect()
    wrong = [r for r in bare if r.status == "ok" and r.utc_us != told[r.row_id][0] and told[r.row_id][0] is not None]
    evidence = Counter()
    for r in tick.select("feed_id", "dt").collect():
        m = re.match(r"\s*(\d+)/(\d+)/\d{4} ", r.dt or "")
        evidence[r.feed_id] += bool(m and (int(m[1]) > 12) != (int(m[2]) > 12))
    enough = {k for k, n in evidence.items() if n >= 6}
    unsure = {r.source for r in bare if r.status == "ambiguous"}
    assert not wrong and len(enough) > 8 and not enough & unsure and unsure


def test_date_orders():
    for n in (30, 3000):
        p, share = date_orders(n, 0, None)
        assert p[0] > 0.999
        p, share = date_orders(0.02 * n, n, None)
        assert p[1] > 0.999
        p, share = date_orders(n, n, None)
        assert p[2] > 0.999 and share == 0.5
    assert np.allclose(date_orders(0, 0, None)[0][:2], 0.495) and date_orders(0, 0, "dmy")[0][1] > 0.999
    # a few slips do not turn a declared order, plain evidence does
    assert date_orders(500, 20, "mdy")[0][0] > 0.999 and date_orders(0, 500, "mdy")[0][1] > 0.999


def test_units_of_counts():
    row = lambda form, key, decade, n: {"form": form, "ok_mdy": 0, "ok_dmy": 0, "key": key, "decade": decade, "n": n}
    weights, units = mixture(pd.DataFrame([row(2, 10_202, None, 50), row(2, 13_202, None, 50), row(1, None, 202, 100)]))
    assert units[10_202]["s"] > 0.999 and units[13_202]["ms"] > 0.999 and abs(weights["iso"] - 0.5) < 0.01
    _, units = mixture(pd.DataFrame([row(2, 10_202, None, 5000), row(2, 13_202, None, 3000)]))
    assert units[10_202]["s"] > 0.999 and units[13_202]["ms"] > 0.999
    # digits of seconds that lead far beyond anything else of a source that lives in the seventies
    weights, units = mixture(pd.DataFrame([row(2, 10_227, None, 20), row(1, None, 197, 5000)]))
    assert units[10_227]["s"] < 0.5


def test_abbreviations_by_date(spark):
    rows = [(1, 1, "01 Jul 1943 10:00:00 EWT", None, None, None), (2, 1, "01 Jul 2025 10:00:00 EST", None, None, None), (3, 2, "01 Feb 1970 10:00:00 BST", None, None, None)]
    got = run(spark, rows, [(1, "America/New_York", "mdy"), (2, "Europe/London", "dmy")])
    assert [got[i] for i in (1, 2, 3)] == [(us(datetime(1943, 7, 1, 14)), "ok"), (us(datetime(2025, 7, 1, 15)), "ok"), (us(datetime(1970, 2, 1, 9)), "ok")]
    msk = zone_abbreviations("Europe/Moscow")["MSK"]
    assert len({off for _, _, off in msk}) > 1


def test_unknown_feed_null_source_and_bad_zone(spark):
    got = run(spark, [(1, 9, "2025-01-01 00:00:00", None, None, None), (2, None, "2025-01-01T00:00:00Z", None, None, None), (3, 3, "2025-01-01 00:00:00", None, None, None), (1, 9, "2025-01-01 00:00:00", None, None, None)], [(3, "Mars/Olympus", "mdy")])
    assert got[1][1] == got[3][1] == "no_zone" and got[2][1] == "ok"


def test_empty(spark):
    assert run(spark, [], []) == {}

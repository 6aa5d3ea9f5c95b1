from collections import defaultdict
from datetime import datetime, time, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebar.operators import grid
from tidebar.operators.grid import bar_grid, slot_text, ssa_impute, ssa_settle, tick_grid
from tidebar.operators.timestamps import normalise_timestamps
from tidebar.plans.training import p3_found, p3_series


def test_ssa_finds_the_wave():
    t = np.arange(300)
    whole = 10 + np.sin(t / 7) + 0.5 * np.cos(t / 3)
    holes = whole.copy()
    gone = np.r_[40:46, 120, 200:208]
    holes[gone] = np.nan
    filled = ssa_impute(holes)
    straight = np.interp(t, np.delete(t, gone), np.delete(whole, gone))
    assert np.abs(filled - whole)[gone].mean() < 0.4 * np.abs(straight - whole)[gone].mean()
    assert np.array_equal(np.delete(filled, gone), np.delete(whole, gone))


def test_ssa_edges():
    assert np.isnan(ssa_impute(np.full(5, np.nan))).all()
    assert ssa_impute(np.array([np.nan, 3.0, np.nan])).tolist() == [3, 3, 3]
    assert len(ssa_impute(np.array([]))) == 0
    flat = np.array([2.0] * 5 + [np.nan] + [2.0] * 20)
    assert ssa_impute(flat)[5] == 2.0


def plain_rounds(values, rounds, rank=8, window=24):
    """The textbook loop without extrapolation, with explicit matrices."""
    miss, n = np.isnan(values), len(values)
    x = np.interp(np.arange(n), np.flatnonzero(~miss), values[~miss])
    centre, spread = values[~miss].mean(), values[~miss].std()
    x = (x - centre) / spread
    kept = 1
    for _ in range(rounds):
        h = np.array([x[i : i + n - window + 1] for i in range(window)])
        u, s, vt = np.linalg.svd(h, full_matrices=False)
        kept = max(kept, min(rank, int(np.searchsorted(np.cumsum(s**2), 0.98 * (s**2).sum())) + 1))
        low = (u[:, :kept] * s[:kept]) @ vt[:kept]
        new = np.array([np.mean([low[i, t - i] for i in range(max(0, t - n + window), min(window - 1, t) + 1)]) for t in np.flatnonzero(miss)])
        x[miss] = new
    return np.clip(x * spread + centre, np.nanmin(values), np.nanmax(values))


def test_extrapolated_rounds_end_where_plain_ones_do():
    rng = np.random.default_rng(3)
    t = np.arange(160)
    holes = np.sin(t / 5) + 0.3 * np.cos(t / 2) + rng.normal(0, 0.02, 160)
    holes[50:62] = holes[100:104] = np.nan
    done = ssa_impute(holes, tolerance=1e-7)
    assert np.abs(done - plain_rounds(holes, 1500)).max() < 0.02
    assert np.abs(plain_rounds(holes, 5) - done).max() > 0.02


@pytest.mark.parametrize("n, gone", [(3, [1]), (5, [2]), (7, [0, 3]), (9, [4, 8])])
def test_short_series_go_through_the_same_rounds(n, gone):
    x = np.arange(n, dtype=float)
    x[gone] = np.nan
    filled, settled = ssa_settle(x)
    assert settled and not np.isnan(filled).any() and filled.min() >= np.nanmin(x) and filled.max() <= np.nanmax(x)


def test_neighbours_fill_a_segment_without_readings(spark):
    feeds = spark.createDataFrame([(1, "UTC", "mdy")], "feed_id int, tz_name string, date_style string")
    start = datetime(2025, 1, 1)
    gap = range(1020, 1070)
    rows = [(i, 5, 1, (start + timedelta(minutes=i)).isoformat() + "Z", float(2 + np.sin(i / 9))) for i in range(3000) if i not in gap]
    df = spark.createDataFrame(rows, "tick_id long, file_id long, feed_id int, dt string, bid double")
    got = {r.slot_us: r.value for r in tick_grid(df, feeds).where("missing").collect()}
    us = int((start - datetime(1970, 1, 1)).total_seconds()) * 10**6
    want = {us + i * 60_000_000: 2 + np.sin(i / 9) for i in gap}
    assert set(got) == set(want) and max(abs(got[k] - want[k]) for k in want) < 0.3


def test_values_that_did_not_settle_are_marked(spark):
    rng = np.random.default_rng(3)
    holes = np.cumsum(rng.normal(0, 1, 200)) + rng.normal(0, 1, 200)
    holes[60:80] = np.nan
    assert ssa_settle(holes)[1] and not ssa_settle(holes, rounds=2)[1]
    day = datetime(2025, 1, 6)
    bars = spark.createDataFrame([(i, 1, day + timedelta(minutes=i), float(i % 7), None) for i in range(90) if i not in (40, 41)], "bar_id long, series_id long, time timestamp_ntz, volume double, loaded_at timestamp_ntz")
    got = bar_grid(bars, spark.createDataFrame([(1, 60)], "series_id long, period_s int"))
    assert got.where("filled").count() == got.where("missing").count() == 2 and got.where("settled").count() == 90


def gappy(seed):
    rng = np.random.default_rng(seed)
    x = np.cumsum(rng.normal(0, 1, 60)) if seed % 2 else rng.exponential(1, 60)
    at = rng.integers(3, 44)
    x[at : at + 12] = np.nan
    x[rng.permutation(58)[:4] + 1] = np.nan
    return x


@pytest.mark.parametrize("seed", [0, 174])
def test_far_resting_points_are_met(seed):
    holes = gappy(seed)
    filled, settled = ssa_settle(holes, rounds=1000)
    assert settled and filled.min() >= np.nanmin(holes) and filled.max() <= np.nanmax(holes)


@pytest.mark.parametrize("n, k", [(60, 24), (11, 5), (4, 2), (3, 2)])
def test_inner_system_says_what_rounds_in_a_subspace_do(n, k):
    rng = np.random.default_rng(n)
    gone = np.sort(rng.permutation(n)[: n // 2 + 1])
    wide, counts = n - k + 1, np.array([sum(0 <= t - i <= n - k for i in range(k)) for t in range(n)], float)
    lead = np.linalg.qr(rng.normal(size=(k, max(1, k // 3))))[0]

    def change(x):
        low = lead @ (lead.T @ np.array([x[i : i + wide] for i in range(k)]))
        return np.array([sum(low[i, t - i] for i in range(k) if 0 <= t - i < wide) / counts[t] for t in gone])

    moves = np.eye(n)[gone]
    want = (1 + grid.DAMP) * np.eye(len(gone)) - np.array([change(x) for x in moves]).T
    assert np.allclose(grid._inner_system(gone, k, wide, counts[gone])(lead @ lead.T), want)


def test_rounds_of_forty_series(monkeypatch):
    rounds, eigh = [], np.linalg.eigh
    monkeypatch.setattr(np.linalg, "eigh", lambda g: rounds.append(1) or eigh(g))
    assert all(ssa_settle(gappy(seed))[1] for seed in range(40))
    assert len(rounds) < 1200


def gaps(df):
    return {(r.source_id, r.s) for r in df.where("missing").select("source_id", slot_text(F.col("slot_us")).alias("s")).collect()}


def test_bars_match_brute_force(spark, small):
    period = {r.series_id: r.period_s for r in spark.read.parquet(f"{small}/series.parquet").collect()}
    bars = spark.read.parquet(f"{small}/bars.parquet")
    by = defaultdict(list)
    for r in bars.collect():
        m = datetime.combine(r.time.date(), time())
        p = period[r.series_id]
        by[r.series_id].append((m + timedelta(seconds=int((r.time - m).total_seconds() // p) * p), r.volume))
    want = set()
    for sid, rows in by.items():
        slots, have = [s for s, _ in rows], {s for s, v in rows if v is not None}
        for day in {(s + timedelta(hours=6)).date() for s in slots}:
            at = datetime.combine(day, time()) - timedelta(hours=6)
            for k in range(86_400 // period[sid]):
                s = at + timedelta(seconds=k * period[sid])
                if min(slots) <= s <= max(slots) and s.hour != 17 and s not in have:
                    want.add((sid, s.strftime("%Y-%m-%d %H:%M:%S")))
    assert gaps(bar_grid(bars, spark.read.parquet(f"{small}/series.parquet"))) == want


def test_ticks_match_brute_force(spark, small):
    ticks, feeds = spark.read.parquet(f"{small}/tick.parquet"), spark.read.parquet(f"{small}/feed.parquet")
    by = defaultdict(set)
    for r in normalise_timestamps(ticks, feeds, "tick_id", "dt", keep=("file_id", "bid")).where("utc_us is not null and bid > 0").collect():
        by[r.file_id].add(r.utc_us // 60_000_000)
    want = {(f, (datetime(1970, 1, 1) + timedelta(minutes=m)).strftime("%Y-%m-%d %H:%M:%S")) for f, s in by.items() for m in range(min(s), max(s) + 1) if m not in s}
    assert gaps(tick_grid(ticks, feeds)) == want


def test_long_gap_over_segments_and_edges(spark):
    feeds = spark.createDataFrame([(1, "UTC", "mdy")], "feed_id int, tz_name string, date_style string")
    rows = [(1, 5, 1, "2025-01-01T00:00:00Z", 1.0), (2, 5, 1, "2025-01-04T00:00:00Z", 2.0), (3, 5, 1, None, 1.0), (4, 5, 1, "2025-01-09T00:00:00Z", None), (5, None, 1, "2025-01-09T00:00:00Z", 1.0), (2, 5, 1, "2025-01-04T00:00:00Z", 2.0), (6, 6, 1, "bad", 1.0), (7, 5, None, "2025-01-09T00:00:00Z", float("nan"))]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "tick_id long, file_id long, feed_id int, dt string, bid double, slot int, filled string")
    got = tick_grid(df, feeds)
    assert got.count() == 3 * 1440 + 1 and got.where("missing").count() == 3 * 1440 - 1
    # segments without any reading near are only marked
    assert got.where("value is null").count() == got.where("missing and not filled").count() == 3 * 1024
    bare = tick_grid(df, feeds, impute=False)
    assert bare.where("missing").count() == 3 * 1440 - 1 and bare.where("filled").count() == 0
    assert tick_grid(df.limit(0), feeds).count() == 0
    bars = spark.createDataFrame([(1, 1, None, 1.0, None)], "bar_id long, series_id long, time timestamp_ntz, volume double, loaded_at timestamp_ntz")
    series = spark.createDataFrame([(1, 60)], "series_id long, period_s int")
    assert bar_grid(bars, series).count() == 0


def test_found_periods_are_those_of_the_filled_series(spark, small, monkeypatch):
    calls, fill = [], grid._fill
    monkeypatch.setattr(grid, "_fill", lambda impute: calls.append(impute) or fill(impute))
    got = {tuple(r) for r in p3_found(spark, small).collect()}
    assert calls == [True, True]
    assert got == {tuple(r) for r in p3_series(spark, small).where("missing").select("origin", "source_id", "slot").collect()}

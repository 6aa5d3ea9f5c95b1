"""Closed forms against bar-by-bar walks."""

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from tidebar.operators import indicators as I

SIX = [(100.0, 101.0, 99.0, 100.5), (100.5, 102.0, 100.0, 101.5), (101.5, 101.8, 98.5, 99.0), (99.0, 100.0, 98.5, 99.8), (99.8, 103.0, 99.5, 102.5), (102.5, 102.6, 101.0, 101.2)]


def arrays(bars):
    a = np.array(bars, float)
    return tuple(a[:, k][None, :] for k in range(4))


def walk_rise(bars, seeded):
    o, h, lo, c = bars[0]
    best, base = (h if o >= c else c) if seeded else c, lo
    for _, h, lo, c in bars[1:]:
        if lo <= base:
            best, base = c, lo
        else:
            best = max(best, h)
    return best - base, base


def walk_drop(bars):
    peak = low = bars[0][3]
    for _, h, lo, c in bars[1:]:
        if h > peak:
            peak, low = h, c
        else:
            low = min(low, lo)
    return peak, peak - low


def walk_worst(bars):
    peak, low, worst = bars[0][1], bars[0][3], 0
    for _, h, lo, c in bars[1:]:
        if h > peak:
            peak, low = h, c
        else:
            low = min(low, lo)
        worst = max(worst, (peak - low) / abs(peak))
    return worst


def test_fixture():
    w = arrays(SIX)
    assert [float(x[0]) for x in I.rise(*w)] == [4.5, 98.5] and float(I.rise(*w, True)[0][0]) == 4.5
    assert [float(x[0]) for x in I.drawdown(*w)] == [103, 2]
    assert abs(float(I.max_drawdown(*w)[0]) - 0.03431372549019608) < 1e-15
    assert int(I.first_peak(w[1], w[3])[0]) == 4
    two = arrays([(10, 12, 9, 9.5), (9.5, 10, 9.2, 9.8)])
    assert (float(I.rise(*two)[0][0]), float(I.rise(*two, True)[0][0])) == (1, 3)


def bar(x):
    o, c, up, down = x
    return (o, max(o, c) + up, min(o, c) - down, c)


bars = st.lists(st.tuples(*[st.integers(50, 56)] * 2, *[st.integers(0, 3)] * 2).map(bar), min_size=1, max_size=9)


@settings(max_examples=500, deadline=None)
@given(bars)
def test_folds(b):
    w = arrays(b)
    for seeded in (False, True):
        assert tuple(float(x[0]) for x in I.rise(*w, seeded)) == walk_rise(b, seeded)
    assert tuple(float(x[0]) for x in I.drawdown(*w)) == walk_drop(b)
    assert float(I.max_drawdown(*w)[0]) == walk_worst(b)
    mirror = [(-o, -lo, -h, -c) for o, h, lo, c in b]
    m = arrays(mirror)
    assert tuple(float(x[0]) for x in I.rise(*m)) == walk_rise(mirror, False)
    assert float(I.max_drawdown(*m)[0]) == walk_worst(mirror)


def frame(spark, rows, **more):
    pdf = pd.DataFrame(rows, columns=["open", "high", "low", "close"]).astype(float)
    pdf["symbol"], pdf["bar_idx"], pdf["ts"] = "x", range(len(pdf)), pd.date_range("2025-01-01", periods=len(pdf), freq="15s")
    for k, v in more.items():
        pdf[k] = v
    return spark.createDataFrame(pdf).withColumn("ts", __import__("pyspark").sql.functions.col("ts").cast("timestamp_ntz"))


def test_range_volatility(spark):
    rows = I.rolling_range_volatility(frame(spark, SIX), ["symbol"], 3).orderBy("bar_idx").collect()
    assert [r.rrv_up for r in rows][2:] == [0.02, 0.014925373134328358, 0.014778325123152709, 0.04040404040404041]
    assert [r.rrv_down for r in rows][2:] == [0.015, 0.01990049751243781, 0.029556650246305417, 0.005050505050505051]
    assert rows[0].rrv_up is None and rows[1].rrv_up is None


def test_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(2)
    c = 100 + np.cumsum(rng.normal(0, 1, 300))
    df = frame(spark, np.stack([c, c + 1, c - 1, c + 0.5], axis=1).tolist(), volume=np.where(rng.random(300) < 0.3, 0.0, 5.0))

    def all_of():
        key = ["symbol"]
        return [sorted(map(str, x.collect())) for x in (I.rolling_folds(df, "symbol", 7, 3), I.rolling_range_volatility(df, key, 7), I.log_returns(df, key), I.halts(df, key), I.time_deltas(df, key), I.forward_variance(I.log_returns(df, key).where("ret is not null"), key, 4, "bar_idx"))]

    whole = all_of()
    monkeypatch.setattr(I, "BLOCK", 32)
    assert all_of() == whole


def test_halts(spark):
    n = 13
    for zeros, halted in ((13, True), (12, False)):
        v = [5.0] * 3 + [0.0] * zeros + [5.0] * 4
        df = frame(spark, [(10, 11, 9, 10 + i * 0.01) for i in range(len(v))], volume=v)
        run = I.halts(df, ["symbol"]).collect()
        assert len(run) == 1 and run[0].halted is halted and run[0].span_s == (zeros - 1) * 15
        r = {x.bar_idx: x.ret for x in I.log_returns(df, ["symbol"]).collect()}
        assert (r[3 + zeros] is None) is halted and r[1] is not None and n


def test_empty(spark):
    df = frame(spark, SIX, volume=[1.0] * 6).limit(0)
    assert I.rolling_folds(df, "symbol", 3, 1).count() == 0 and I.log_returns(df, ["symbol"]).count() == 0

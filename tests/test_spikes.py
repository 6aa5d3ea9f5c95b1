import numpy as np
import pytest

from tidebar.operators import spikes as S


def walk(n, seed=0, sd=1e-4):
    c = 100 * np.exp(np.cumsum(np.random.default_rng(seed).normal(0, sd, n)))
    o = np.r_[c[0], c[:-1]]
    return np.stack([o, np.maximum(o, c) * (1 + sd), np.minimum(o, c) * (1 - sd), c], axis=1)


def states(p, v=None, usual=7e-5):
    return S.judge(p, np.full(len(p), 10.0) if v is None else v, usual)[0]


def test_spikes_and_levels():
    p = walk(400)
    p[100] *= 1.02
    p[200:203] *= 0.98
    p[300:] *= 1.05  # a lasting level is none
    p[50, 1] *= 1.01  # one price only
    s = states(p)
    assert np.flatnonzero(s).tolist() == [50, 100, 200, 201, 202]


def test_stuck_runs():
    p, v = walk(100), np.full(100, 10.0)
    p[20:27] = p[20]
    p[40:44] = p[40]
    p[60:70] = p[60]
    v[60:70] = 0
    assert np.flatnonzero(states(p, v)).tolist() == list(range(21, 27))


def test_hard_faults_and_nulls():
    p = walk(60)
    p[5, 1], p[5, 2] = p[5, 2], p[5, 1]
    p[9, 3] = 0
    p[12, 0] = np.nan
    p[13] = np.nan
    assert np.flatnonzero(states(p)).tolist() == [5, 9]


def frame(spark, p, v, series=1, start=0, extra=()):
    from datetime import datetime, timedelta

    rows = [(start + i, series, datetime(2025, 1, 1) + timedelta(seconds=15 * i), *[None if np.isnan(x) else float(x) for x in p[i]], None if np.isnan(v[i]) else float(v[i]), "clash", 7) for i in range(len(p))]
    return spark.createDataFrame([*rows, *extra], "bar_id long, series_id long, time timestamp_ntz, open double, high double, low double, close double, volume double, state string, block int")


def test_blocks_give_what_the_whole_gives(spark, monkeypatch):
    p, v = walk(700, 3), np.full(700, 10.0)
    p[[130, 255, 256, 400]] *= 1.03
    p[500:520] = p[500]
    df = frame(spark, p, v)
    whole = {r.bar_id: r.state for r in S.flag_bars(df).collect()}
    monkeypatch.setattr(S, "BLOCK", 128)
    assert {r.bar_id: r.state for r in S.flag_bars(df).collect()} == whole
    assert [i for i, s in sorted(whole.items()) if s == "spike"] == [130, 255, 256, 400]
    assert [i for i, s in sorted(whole.items()) if s == "stuck"] == list(range(501, 520))


def test_copies_share_states(spark):
    p, v = walk(200, 5), np.full(200, 10.0)
    p[100] *= 1.05
    df = frame(spark, p, v)
    copies = df.where("bar_id in (100, 50)").selectExpr("bar_id + 1000 as bar_id", *df.columns[1:])
    got = {r.bar_id: r.state for r in S.flag_bars(df.unionByName(copies).unionByName(copies.selectExpr("bar_id + 1000 as bar_id", *df.columns[1:]))).collect()}
    assert len(got) == 204 and got[100] == got[1100] == got[2100] == "spike" and got[1050] == "normal"


def test_edges(spark):
    df = frame(spark, np.full((3, 4), np.nan), np.full(3, np.nan), extra=[(90, None, None, 1.0, 1.0, 1.0, -1.0, None, None, None), (91, None, None, None, None, None, None, None, None, None)])
    got = {r.bar_id: r.state for r in S.flag_bars(df).collect()}
    assert got == {0: "normal", 1: "normal", 2: "normal", 90: "out_of_range", 91: "normal"}
    assert S.flag_bars(df.limit(0)).count() == 0


def slow_posterior(like, trans, start, end):
    """Sum over all paths."""
    from itertools import product

    p = np.zeros_like(like)
    for path in product(range(like.shape[1]), repeat=len(like)):
        w = start[path[0]] * end[path[-1]]
        for t, s in enumerate(path):
            w *= like[t, s] * (trans[path[t - 1], s] if t else 1.0)
        for t, s in enumerate(path):
            p[t, s] += w
    return p / p.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("n", [1, 2, 4])
def test_forward_backward_is_the_sum_over_paths(n):
    rng = np.random.default_rng(n)
    like = rng.random((2, n + 1, 8)) + 1e-9
    trans = S.transitions(np.array([0.01, 0.05]), np.array([0.02, 0.01]))
    assert np.allclose(trans.sum(axis=2), 1)
    length = np.array([n + 1, n])
    like[1, n:] = 1.0
    got = S.forward_backward(like, trans, length)
    end = np.ones(8)
    end[3:7] = 0
    for k in range(2):
        start = trans[k, 0] + 1e-3 * (np.arange(8) == 7)
        assert np.allclose(got[k, : length[k]], slow_posterior(like[k, : length[k]], trans[k], start, end))


@pytest.mark.parametrize("scale", [1e-5, 1e-3, 1.0])
def test_fit_finds_width_and_rates(scale):
    rng = np.random.default_rng(7)
    z = np.abs(rng.standard_t(6, 20_000)) * 2.5
    z[:100] = np.exp(rng.uniform(np.log(40), np.log(2000), 100))
    counts = np.histogram(z, S._EDGES)[0][None].astype(float)
    p = S.fit_series(counts, np.array([40]), np.array([3]), np.array([20_000]))
    assert abs(p["width"][0] / 2.5 - 1) < 0.1 and abs(p["spike"][0] / 0.005 - 1) < 0.3 and p["repeat"][0] < 0.01
    # a series that moves more is judged by its own moves, whatever the scale
    p = walk(3000, 5, scale * 1e-2)
    usual = float(np.median(np.abs(np.diff(np.log(p[:, 3])))))
    quiet = S.judge(p, np.full(3000, 1.0), usual)[0]
    assert quiet.sum() == 0
    p[1500] *= np.exp(60 * usual)
    assert np.flatnonzero(S.judge(p, np.full(3000, 1.0), usual)[0]).tolist() == [1500]


def test_long_frozen_run_over_block_edges(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 128)
    p, v = walk(600, 9), np.full(600, 10.0)
    p[100:420] = p[100]
    got = {r.bar_id: r.state for r in S.flag_bars(frame(spark, p, v)).collect()}
    assert [i for i, s in sorted(got.items()) if s != "normal"] == list(range(101, 420))

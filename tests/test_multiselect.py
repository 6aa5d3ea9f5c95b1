import math

import numpy as np
import pytest

from tidebar.operators import multiselect as M

PROBS = [0.0, 0.05, 0.5, 0.9, 1.0]


def exact(v, p):
    v = sorted(v)
    return v[max(math.ceil(p * len(v) - 1e-9), 1) - 1]


@pytest.fixture
def table(spark):
    rng = np.random.default_rng(1)
    rows, i = [], 0
    for g, n in (("a", 5000), ("b", 3), ("c", 900), (None, 40), ("e", 0)):
        for x in (rng.pareto(1.5, n) if g != "c" else rng.integers(0, 5, n)):
            rows.append((i, g, i % 7, float(x)))
            i += 1
    bad = [(i + k, g, k, v) for k, (g, v) in enumerate([("a", None), ("a", float("nan")), ("b", float("inf")), ("e", None), ("c", float("-inf"))])]
    return rows, spark.createDataFrame([(*r, 1, "x") for r in rows + bad], "id long, g string, day int, v double, chunk int, gid string")


@pytest.mark.parametrize("sizes", [(4096, 256, 4096), (256, 2, 20)])
def test_exact(spark, table, monkeypatch, sizes):
    for name, v in zip(("CHUNK", "FAN", "FEW"), sizes):
        monkeypatch.setattr(M, name, v)
    rows, df = table
    got = {r.g: r for r in M.multi_select(df, ["g"], "v", PROBS, "id").collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, r in got.items():
        v = [x[3] for x in rows if x[1] == g]
        assert r.n == len(v)
        assert [r[f"q{i}"] for i in range(len(PROBS))] == [exact(v, p) for p in PROBS], g


def test_days_combine_within_their_error(spark, table, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 256)
    rows, df = table
    days = M.day_summaries(df, ["g"], "day", "v", "id", error=0.02)
    first, rest = days.where("day < 3"), days.where("day >= 3")
    assert days.count() < len(rows) / 3
    for r in M.combine_summaries(first.unionByName(rest), ["g"], PROBS).collect():
        v = np.sort([x[3] for x in rows if x[1] == r.g])
        assert r.n == len(v)
        for i, p in enumerate(PROBS):
            k = max(math.ceil(p * len(v)), 1) - 1
            lo, hi = np.searchsorted(v, r[f"q{i}"], "left"), np.searchsorted(v, r[f"q{i}"], "right") - 1
            off = max(lo - k, k - hi, 0)
            # one summary step at most, as a chunk's last run may be short
            assert off <= max(2 * M.rank_error(len(v), 0.02), 1), (r.g, p, off)


def test_empty_and_all_equal(spark, table):
    _, df = table
    assert M.multi_select(df.limit(0), ["g"], "v", [0.5], "id").count() == 0
    same = spark.range(20_000).selectExpr("id", "'x' as g", "2.5d as v")
    r = M.multi_select(same, ["g"], "v", [0.01, 0.99], "id").first()
    assert (r.n, r.q0, r.q1) == (20_000, 2.5, 2.5)


@pytest.mark.parametrize("sizes", [(4096, 256, 4096), (64, 4, 10)])
def test_interpolated(spark, table, monkeypatch, sizes):
    for name, v in zip(("CHUNK", "FAN", "FEW"), sizes):
        monkeypatch.setattr(M, name, v)
    rows, df = table
    for r in M.interpolated(df, ["g"], "v", PROBS, "id").collect():
        v = [x[3] for x in rows if x[1] == r.g]
        assert r.n == len(v) and np.allclose([r[f"q{i}"] for i in range(len(PROBS))], np.quantile(v, PROBS), rtol=1e-12)


def test_null_keys_stay_apart(spark):
    rows = [(i, None if i < 10 else "x", "x" if i < 10 else None, float(i if i < 10 else 90 + i)) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, a string, b string, v double")
    got = {(r.a, r.b): (r.n, r.q0) for r in M.multi_select(df, ["a", "b"], "v", [0.5], "id").collect()}
    assert got == {(None, "x"): (10, 4.0), ("x", None): (10, 104.0)}


def test_weights(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 32)
    monkeypatch.setattr(M, "FEW", 30)
    rng = np.random.default_rng(4)
    rows = [(i, float(v), float(w)) for i, (v, w) in enumerate(zip(rng.integers(0, 60, 300), rng.integers(1, 9, 300)))]
    r = M.multi_select(spark.createDataFrame(rows, "id long, v double, w double"), [], "v", PROBS, "id", "w").first()
    flat = [v for _, v, w in rows for _ in range(int(w))]
    assert r.n == len(flat) and [r[f"q{i}"] for i in range(len(PROBS))] == [exact(flat, p) for p in PROBS]


def test_rounds_drop_what_they_rule_out(spark, monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 64)
    monkeypatch.setattr(M, "FEW", 8)
    left = []
    monkeypatch.setattr(M, "drop_table", lambda t: t is None or left.append(t.selectExpr("sum(size(vals))").first()[0]))
    df = spark.range(4000).selectExpr("id", "cast((id * 7919) % 4001 as double) as v")
    v = [float((i * 7919) % 4001) for i in range(4000)]
    assert M.multi_select(df, [], "v", [0.5], "id").first().q0 == exact(v, 0.5)
    assert len(left) >= 4 and all(b <= 0.8 * a for a, b in zip(left, left[1:]))

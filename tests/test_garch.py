import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidebar.operators import garch as G


def test_recursion_and_horizon(spark):
    h = G.variance_path(np.array([0.2, -0.4, 1.0]), 0, 0.1, 0.1, 0.8, 1.0, 0.5)
    assert np.allclose(h, [0.925, 0.844, 0.7912])
    one = spark.range(1).select(*[G.horizon_variance(F.lit(1.0), 4, F.lit(w), F.lit(g)).alias(n) for n, w, g in (("a", 0.1, 0.9), ("b", 0.1, 1.0))]).first()
    assert abs(one.a - 4.0) < 1e-12 and abs(one.b - (4 + 0.1 * 6)) < 1e-12


def test_fit_finds_the_process():
    rng = np.random.default_rng(4)
    omega, alpha, beta, n = 0.05, 0.1, 0.85, 12_000
    r, h, e = np.empty(n), 1.0, 0.0
    for t in range(n):
        h = omega + alpha * e * e + beta * h
        e = np.sqrt(h) * rng.standard_normal()
        r[t] = 0.02 + e
    f = G.fit_one(r)
    assert abs(f["alpha"] - alpha) < 0.03 and abs(f["beta"] - beta) < 0.05 and abs(f["mu"] - 0.02) < 0.03
    assert f["loglik"] > -0.5 * np.sum(np.log(2 * np.pi * r.var()) + (r - r.mean()) ** 2 / r.var())


def test_scores_against_least_squares(spark):
    rng = np.random.default_rng(1)
    p = rng.random(400) + 0.5
    y = 0.1 + 0.8 * p + rng.normal(0, 0.2, 400)
    s = G.forecast_scores(spark.createDataFrame(pd.DataFrame({"k": 1, "sigma2_hat": p, "rv": y})), ["k"]).first()
    b, a = np.polyfit(p, y, 1)
    assert abs(s.slope - b) < 1e-9 and abs(s.intercept - a) < 1e-9
    sse1, sse0 = np.sum((y - a - b * p) ** 2), np.sum((y - p) ** 2)
    f = ((sse0 - sse1) / 2) / (sse1 / 398)
    assert abs(s.p_value - (1 + 2 * f / 398) ** -199) < 1e-9
    assert abs(s.qlike - np.mean(np.log(p) + y / p)) < 1e-12


def test_validity(spark):
    base = {"n": 500, "qlike": 1.0, "omega": 0.1, "alpha": 0.1, "beta": 0.8, "mean_pred": 1.0, "mean_rv": 1.0}
    cases = [{}, {"n": 10}, {"qlike": float("nan")}, {"omega": 0.0}, {"alpha": -0.1}, {"beta": 0.95}, {"mean_pred": 9.0}, {"mean_rv": 0.0}]
    want = ["", "few_rows", "qlike", "omega", "negative", "unstable", "ratio", "means"]
    rows = spark.createDataFrame(pd.DataFrame([base | c | {"i": i} for i, c in enumerate(cases)]))
    assert [r.reasons for r in G.validity(rows, 12, 300).orderBy("i").collect()] == want
    assert G.validity(rows, 12, 60).orderBy("i").first().reasons == "horizon"
    assert G.horizon_for_hour(240, 15) == 240 and G.horizon_for_hour(240, 30) == 120


def test_quantiles(spark):
    x = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([3, 1, 2])], "k int, i int, v double")
    q = G.qq_pairs(x, ["k"], "v", "i").orderBy("rank").collect()
    assert [r.observed for r in q] == [1, 2, 3] and abs(q[1].theoretical) < 1e-12 and abs(q[0].theoretical + q[2].theoretical) < 1e-12


def test_every_series_is_forecast_an_hour_ahead(spark, small):
    import __spark_entry__ as entry

    period = {r.series_id: r.period_s for r in spark.read.parquet(f"{small}/series.parquet").collect()}
    got = entry.queries()["garch_validation"](spark, small).collect()
    assert got and all(r.horizon == 3600 // period[r.series_id] for r in got)


def test_realised_variance_has_the_horizon_of_its_series(spark):
    rng = np.random.default_rng(8)
    seconds = {1: 900.0, 2: 300.0, 3: 86_400.0, 4: None}
    ret = {k: rng.normal(0, 1, 120) for k in seconds}
    rows = spark.createDataFrame([(k, i, float(v)) for k in seconds for i, v in enumerate(ret[k])], "k int, i long, ret double")
    spans = {1: 4, 2: 12, 3: 1, 4: 12}
    rows = rows.unionByName(spark.createDataFrame([(5, i, float(i % 3)) for i in range(30)], "k int, i long, ret double"))
    evaluated, report = G.validate_forecast(rows, ["k"], "i", 12, spark.createDataFrame(list(seconds.items()), "k int, seconds double"))
    for r in evaluated.collect():
        assert abs(r.rv - np.sum(ret[r.k][r.i + 1 : r.i + 1 + spans[r.k]] ** 2)) < 1e-9
    got = {r.k: r for r in report.collect()}
    short = got.pop(5)  # ten test rows, fewer than its horizon
    assert short.n == 0 and not short.valid and "few_rows" in short.reasons
    assert {k: r.horizon for k, r in got.items()} == spans
    assert {k: r.n for k, r in got.items()} == {k: 36 - h for k, h in spans.items()}


def test_fit_far_out_is_bounded():
    f = G.fit_one(np.random.default_rng(78).uniform(-1, 1, 60))
    assert np.isfinite(f["loglik"]) and f["alpha"] + f["beta"] < 1


def test_blocks_give_the_path_of_the_whole(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(k, i + 5, float(x), 0.01 * k, 0.1, 0.1, 0.8, 1.0, 0.5) for k in (1, 2) for i, x in enumerate(rng.normal(0, 1, 1000 if k == 1 else 37))]
    df = spark.createDataFrame(rows, "k long, i long, ret double, mu double, omega double, alpha double, beta double, h0 double, eps0 double")
    monkeypatch.setattr(G, "VARIANCE_BLOCK", 64)
    got = {(r.k, r.i): r.h for r in G.conditional_variance(df, ["k"], "i").collect()}
    assert len(got) == len(rows)
    for k in (1, 2):
        mine = [r for r in rows if r[0] == k]
        want = G.variance_path(np.array([r[2] for r in mine]), *mine[0][3:])
        assert np.allclose([got[k, r[1]] for r in mine], want, rtol=1e-12)

"""Conditional variance: fit, recursion, horizon sums, and the checks of a forecast against realised variance."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..scale import blocked, by_group, lookup_join, ranked, scan_groups
from ..session import materialize
from .indicators import forward_variance

FLOOR = 1e-18
QQ_PIECES = 64
#: Rows of a key whose variances are worked out in one go.
VARIANCE_BLOCK = 8192
#: Least rows of an evaluation, and bounds on mean forecast over mean realised variance.
LEAST_ROWS, RATIO_LOW, RATIO_HIGH = 300, 0.2, 5.0
_FIT = "mu double, omega double, alpha double, beta double, h_last double, eps_last double, loglik double, n long"


def variance_path(r: np.ndarray, mu: float, omega: float, alpha: float, beta: float, h0: float, eps0: float) -> np.ndarray:
    """Conditional variances h_t from the last variance and shock before the first return."""
    h, e, out = h0, eps0, np.empty(len(r))
    for t, x in enumerate(r.tolist()):
        h = omega + alpha * e * e + beta * h
        out[t] = h
        e = x - mu
    return out


def split_rows(rows: DataFrame, keys: list[str], index: str, ratio: float = 0.7, least: int = 10) -> DataFrame:
    """``is_train`` by time: the first floor(n * ratio) rows, kept between ``least`` and n - ``least``."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    cut = F.least(F.greatest(F.floor(F.col("_n") * ratio), F.lit(least)), F.col("_n") - least)
    return rows.join(n, keys).withColumn("is_train", F.col(index) < cut).drop("_n")


def _loglik(theta: np.ndarray, r: np.ndarray) -> tuple[float, float, np.ndarray]:
    """(negative log-likelihood, mean, variances) of unconstrained parameters; variance starts at the sample's."""
    mu, omega, alpha, beta = _unpack(theta, r)
    h, e = variance_path_from(r, mu, omega, alpha, beta)
    return float(0.5 * np.sum(np.log(2 * np.pi * h) + e * e / h)), mu, h


def _unpack(theta: np.ndarray, r: np.ndarray) -> tuple[float, float, float, float]:
    """Any four numbers as mean, omega > 0, alpha, beta >= 0 with alpha + beta < 1."""
    scale = r.var() + 1e-12
    total = 0.9999 / (1 + math.exp(-theta[2]))
    part = 1 / (1 + math.exp(-theta[3]))
    return float(r.mean() + theta[0] * math.sqrt(scale)), float(math.exp(theta[1]) * scale), total * part, total * (1 - part)


def variance_path_from(r: np.ndarray, mu: float, omega: float, alpha: float, beta: float) -> tuple[np.ndarray, np.ndarray]:
    e = r - mu
    start = float((e * e).mean()) + 1e-18
    h = np.empty(len(r))
    h[0] = start
    s = (omega + alpha * e[:-1] ** 2).tolist()
    v = start
    for t, x in enumerate(s, 1):
        v = x + beta * v
        h[t] = v
    return h, e


def fit_one(r: np.ndarray, rounds: int = 400) -> dict[str, float]:
    """Maximum likelihood by a downhill simplex on unconstrained parameters."""
    points = [np.array(p, float) for p in ((0, math.log(0.05), 2.5, -2.0), (0.02, math.log(0.05), 2.5, -2.0), (0, math.log(0.1), 2.5, -2.0), (0, math.log(0.05), 1.5, -2.0), (0, math.log(0.05), 2.5, -1.0))]
    value = lambda p: _loglik(np.clip(p, -30, 30), r)[0]
    simplex = sorted(((value(p), k, p) for k, p in enumerate(points)), key=lambda x: x[0])
    for _ in range(rounds):
        simplex.sort(key=lambda x: x[0])
        if abs(simplex[-1][0] - simplex[0][0]) < 1e-8 * (1 + abs(simplex[0][0])):
            break
        centre = np.mean([p for _, _, p in simplex[:-1]], axis=0)
        worst = simplex[-1][2]
        mirrored = 2 * centre - worst
        f1 = value(mirrored)
        if f1 < simplex[0][0]:
            p2 = centre + 2 * (centre - worst)
            f2 = value(p2)
            simplex[-1] = (f2, 0, p2) if f2 < f1 else (f1, 0, mirrored)
        elif f1 < simplex[-2][0]:
            simplex[-1] = (f1, 0, mirrored)
        else:
            p3 = centre + 0.5 * ((mirrored if f1 < simplex[-1][0] else worst) - centre)
            f3 = value(p3)
            if f3 < min(f1, simplex[-1][0]):
                simplex[-1] = (f3, 0, p3)
            else:
                best = simplex[0][2]
                simplex = [simplex[0], *[(value(q), 0, q) for q in (best + 0.5 * (p - best) for _, _, p in simplex[1:])]]
    best = np.clip(min(simplex, key=lambda x: x[0])[2], -30, 30)
    mu, omega, alpha, beta = _unpack(best, r)
    h, e = variance_path_from(r, mu, omega, alpha, beta)
    return {"mu": mu, "omega": omega, "alpha": alpha, "beta": beta, "h_last": float(h[-1]), "eps_last": float(e[-1]), "loglik": -_loglik(best, r)[0], "n": len(r)}


def garch_fit(train: DataFrame, keys: list[str], index: str, value: str = "ret") -> DataFrame:
    """GARCH(1,1) with a constant mean and normal shocks per key; keys with under 10 returns have no row."""
    schema = ", ".join(f"{k} {dict(train.dtypes)[k]}" for k in keys) + ", " + _FIT

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.sort_values(index, kind="stable")[value].dropna().to_numpy(float)
        names = [c.split()[0] for c in schema.split(", ")]
        if len(r) < 10 or not r.std() > 0:
            return pd.DataFrame(columns=names)
        return pd.DataFrame([{k: pdf[k].iloc[0] for k in keys} | fit_one(r)])[names]

    return by_group(train.select(*keys, index, value), *keys).groupBy(*keys).applyInPandas(run, schema)


def conditional_variance(rows: DataFrame, keys: list[str], index: str, value: str = "ret") -> DataFrame:
    """``h`` at every row from the parameters on it (mu, omega, alpha, beta, h0, eps0), in order of ``index``.

    ``index`` numbers a key's rows without gaps. A step is affine in the variance before it, so a block of rows is as well:
    each block is reduced to its two factors, the factors are chained over a key's blocks with one row each, and then every
    block is worked out from the variance it begins with.
    """
    names = ["mu", "omega", "alpha", "beta", "h0", "eps0"]
    first = rows.groupBy(*keys).agg(F.min(index).alias("_first"))
    x = rows.select(*keys, index, value, *names).join(first, keys)
    x = blocked(x.withColumn("_at", F.col(index) - F.col("_first")), keys, "_at", VARIANCE_BLOCK, before=1)
    w = Window.partitionBy(*keys, "_block").orderBy("_at")
    shock = F.coalesce(F.lag(F.col(value) - F.col("mu")).over(w), F.col("eps0"))
    x = x.withColumn("_s", F.col("omega") + F.col("alpha") * shock * shock).where("_core").select(*keys, index, value, "_block", "_at", "_s", "beta", "h0")
    x = materialize(x, "shocks")
    # the block as h -> h * beta ** n + sum of beta ** (rows after) * s
    last = F.greatest(F.col("_block") * VARIANCE_BLOCK + VARIANCE_BLOCK - 1, F.lit(0))
    parts = x.groupBy(*keys, "_block").agg(F.count("*").alias("_n"), F.sum(F.pow("beta", (last - F.col("_at")).cast("double")) * F.col("_s")).alias("_a"), F.first("beta").alias("beta"), F.first("h0").alias("h0"))
    schema = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys) + ", _block long, _start double"

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        h, out = float(pdf["h0"].iloc[0]), []
        for n, a, beta in zip(pdf["_n"], pdf["_a"], pdf["beta"]):
            out.append(h)
            h = h * beta**n + a  # only a key's last block is short, and nothing follows it
        return pdf[[*keys, "_block"]].assign(_start=out)

    starts = materialize(parts.groupBy(*keys).applyInPandas(chain, schema), "starts")
    kinds = dict(rows.dtypes)
    fields = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {index} long, {value} double, h double"

    def start(piece: pa.Table) -> dict:
        return {"h": float(piece["_start"][0].as_py())}

    def step(state: dict, piece: pa.Table) -> pa.Table:
        h, out = state["h"], np.empty(piece.num_rows)
        beta = float(piece["beta"][0].as_py())
        for t, s in enumerate(piece["_s"].to_numpy().tolist()):
            h = s + beta * h
            out[t] = h
        state["h"] = h
        return pa.table({c: piece[c] for c in (*keys, index, value)} | {"h": pa.array(out)})

    return scan_groups(lookup_join(x, starts, [*keys, "_block"], "inner"), [*keys, "_block"], "_at", start, step, fields)


def next_variance(ret: Column, h: Column, mu: Column, omega: Column, alpha: Column, beta: Column) -> Column:
    """One step ahead of a row whose return is known."""
    return omega + alpha * (ret - mu) * (ret - mu) + beta * h


def horizon_variance(h1: Column, horizon: int | Column, omega: Column, g: Column) -> Column:
    """Sum of the expected variances of the next ``horizon`` steps; g is alpha + beta."""
    if not isinstance(horizon, Column) and horizon <= 0:
        raise ValueError("the horizon must be a positive number of bars")
    a = (1 - F.pow(g, F.lit(horizon))) / (1 - g)
    return F.when(F.abs(1 - g) < 1e-10, horizon * h1 + omega * (horizon * (horizon - 1) / 2)).otherwise(omega / (1 - g) * (horizon - a) + h1 * a)


def forecast_scores(evaluated: DataFrame, keys: list[str], predicted: str = "sigma2_hat", realised: str = "rv") -> DataFrame:
    """Regression of realised on predicted variance with R² and the p-value of intercept 0 and slope 1, QLIKE, means, ratio."""
    p, r = F.col(predicted), F.col(realised)
    x = evaluated.where(p.isNotNull() & r.isNotNull() & ~F.isnan(p) & ~F.isnan(r))
    safe = F.greatest(p, F.lit(FLOOR))
    s = x.groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_intercept(r, p).alias("intercept"), F.regr_slope(r, p).alias("slope"), F.regr_r2(r, p).alias("r2"), F.avg(F.ln(safe) + r / safe).alias("qlike"), F.avg(p).alias("mean_pred"), F.avg(r).alias("mean_rv"),
        F.sum((r - p) * (r - p)).alias("_sse0"), F.regr_syy(r, p).alias("_syy"),
    )
    sse = F.col("_syy") * (1 - F.col("r2"))
    dof = F.col("n") - 2
    f = ((F.col("_sse0") - sse) / 2) / (sse / dof)
    # exact for two restrictions
    p_value = F.when((F.col("n") > 2) & (sse > 0), F.pow(1 + 2 * F.greatest(f, F.lit(0.0)) / dof, -dof / 2))
    return s.withColumns({"p_value": p_value, "ratio": F.when(F.col("mean_rv") > 0, F.col("mean_pred") / F.col("mean_rv"))}).drop("_sse0", "_syy")


def validity(scores: DataFrame, horizon: int | Column, seconds: float | Column | None) -> DataFrame:
    """``reasons`` against a forecast (needs n, qlike, omega, alpha, beta, mean_pred, mean_rv) and ``valid``."""
    g = F.col("alpha") + F.col("beta")
    horizon = F.lit(horizon)
    off = F.coalesce(F.abs(horizon - hour_bars(seconds)) > 1, F.lit(False))
    good_means = (F.col("mean_rv") > 0) & (F.abs("mean_rv") < float("inf")) & (F.abs("mean_pred") < float("inf"))
    ratio = F.col("mean_pred") / F.col("mean_rv")
    checks = [
        ("horizon", off), ("few_rows", F.col("n") < F.greatest(F.lit(LEAST_ROWS), 2 * horizon)), ("qlike", ~F.coalesce(F.abs("qlike") < float("inf"), F.lit(False))), ("omega", ~F.coalesce(F.col("omega") > 0, F.lit(False))),
        ("negative", (F.col("alpha") < 0) | (F.col("beta") < 0)), ("unstable", g >= 1), ("ratio", F.coalesce(good_means & ((ratio < RATIO_LOW) | (ratio > RATIO_HIGH)), F.lit(False))), ("means", ~F.coalesce(good_means, F.lit(False))),
    ]
    reasons = F.array_compact(F.array(*[F.when(c, name) for name, c in checks]))
    return scores.withColumn("reasons", F.array_join(reasons, ",")).withColumn("valid", F.col("reasons") == "")


def hour_bars(seconds: float | Column | None) -> Column:
    """Bars of an hour, null where the bar length is unknown; ties go to the even number as in Python."""
    return F.bround(F.try_divide(F.lit(3600.0), F.lit(seconds).cast("double"))).cast("int")


def horizon_for_hour(horizon: int, seconds: int) -> int:
    """The horizon, or the bars of an hour where it is off by more than one."""
    expected = round(3600 / seconds)
    return expected if abs(horizon - expected) > 1 else horizon


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    inverse = NormalDist().inv_cdf
    return p.map(lambda x: inverse(x) if x is not None and 0 < x < 1 else None)


def qq_pairs(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Values by rank with their plotting position (i - 0.5) / n and the normal quantile there; ties go by ``order``."""
    x = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    n = x.groupBy(*keys).agg(F.count("*").alias("n"))
    # a key's own quantiles cut it into pieces of about equal size, whose sizes add up to the ranks
    cuts = x.groupBy(*keys).agg(F.percentile_approx(value, [i / QQ_PIECES for i in range(1, QQ_PIECES)], 10 * QQ_PIECES).alias("_cuts"))
    x = lookup_join(x, materialize(cuts, "cuts"), keys).withColumn("_b", F.size(F.filter("_cuts", lambda c: c <= F.col(value)))).drop("_cuts")
    x = ranked(x, keys, "_b", [value, order])
    x = x.withColumn("rank", F.col("_rank") + 1).join(n, keys).withColumn("position", (F.col("rank") - 0.5) / F.col("n"))
    return x.select(*keys, order, "rank", "position", normal_quantile("position").alias("theoretical"), F.col(value).alias("observed"))


def hour_horizons(returns: DataFrame, keys: list[str], horizon: int, seconds: float | DataFrame | None) -> DataFrame:
    """``keys, seconds, horizon``: the horizon of each key, at least one bar, by ``horizon_for_hour`` where its bar length is known."""
    known = returns.select(*keys).distinct()
    if isinstance(seconds, DataFrame):
        known = known.join(seconds.select(*keys, F.col("seconds").cast("double").alias("seconds")), keys, "left")
    else:
        known = known.withColumn("seconds", F.lit(seconds).cast("double"))
    expected = hour_bars(F.col("seconds"))
    return known.withColumn("horizon", F.when(F.abs(horizon - expected) > 1, F.greatest(expected, F.lit(1))).otherwise(horizon))


def validate_forecast(returns: DataFrame, keys: list[str], index: str, horizon: int = 240, seconds: float | DataFrame | None = None, train_ratio: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(evaluated rows, report) of a fit on the first part of each key's returns, tested on the rest.

    ``returns`` has ``keys, index, ret`` (numbered without gaps, already scaled); ``seconds`` is the bar length, one for all
    or a table ``keys, seconds``. Each key's horizon is brought to an hour where its bar length says so, and is in the
    report. Realised variance runs over the whole sample, once per distinct horizon, and is taken on the test part.
    """
    returns = materialize(returns, "returns")
    spans = materialize(hour_horizons(returns, keys, horizon, seconds), "horizons")
    rows = split_rows(returns, keys, index, train_ratio)
    fit = materialize(garch_fit(rows.where("is_train"), keys, index), "fit")
    test = rows.where("not is_train").join(fit.withColumnsRenamed({"h_last": "h0", "eps_last": "eps0"}).drop("n", "loglik"), keys)
    h = conditional_variance(test, keys, index).join(fit.select(*keys, "mu", "omega", "alpha", "beta"), keys).join(spans, keys)
    h1 = next_variance(F.col("ret"), F.col("h"), F.col("mu"), F.col("omega"), F.col("alpha"), F.col("beta"))
    h = h.withColumn("h1", h1).withColumn("sigma2_hat", horizon_variance(F.col("h1"), F.col("horizon"), F.col("omega"), F.col("alpha") + F.col("beta")))
    rv = None
    for n in sorted(r[0] for r in spans.select("horizon").distinct().collect()) or [horizon]:
        part = forward_variance(returns.join(spans.where(F.col("horizon") == n).select(*keys), keys, "left_semi"), keys, n, index).select(*keys, index, "rv")
        rv = part if rv is None else rv.unionByName(part)
    evaluated = h.join(rv, [*keys, index], "left").where("rv is not null and sigma2_hat is not null")
    evaluated = evaluated.select(*keys, index, "sigma2_hat", "rv", F.sqrt("sigma2_hat").alias("vol_hat"), F.sqrt("rv").alias("vol_real"))
    # a key that could not be fitted, or whose test part is no longer than its horizon, gets its verdict too
    scores = spans.join(forecast_scores(evaluated, keys), keys, "left").join(fit.select(*keys, "mu", "omega", "alpha", "beta"), keys, "left").fillna(0, ["n"])
    return evaluated, validity(scores, F.col("horizon"), F.col("seconds"))

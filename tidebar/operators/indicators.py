"""Rolling and path-dependent indicators over bars numbered by ``bar_idx`` within their keys.

Frames of bounded reach run on blocks of a key with the rows around them (``scale.blocked``), so a long series is spread
over tasks. Folds over the last W bars are worked out for all windows of a block at once from their closed forms.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import blocked, by_group, last_known, lookup_join
from ..session import materialize
from .multiselect import interpolated

BLOCK = 8192
#: Runs without volume that last so long count as a halt.
HALT_SECONDS = 180


# --- folds over windows: arrays of shape (windows, bars) ------------------------------------------------------------


def _after(values: np.ndarray, k: np.ndarray, empty: float, pick: Callable) -> np.ndarray:
    """Extreme of the columns after k, ``empty`` where there is none."""
    later = np.arange(values.shape[1]) > k[:, None]
    return pick(np.where(later, values, empty), axis=1)


def _at(values: np.ndarray, k: np.ndarray) -> np.ndarray:
    return values[np.arange(len(values)), k]


def rise(o: np.ndarray, h: np.ndarray, lo: np.ndarray, c: np.ndarray, seeded: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(rise, base): from the last lowest low to the highest point after it, that bar counting with its close.

    ``seeded``: if the lowest low is the first bar's, the walk starts from its high when it fell and its close when not.
    """
    k = lo.shape[1] - 1 - np.argmin(lo[:, ::-1], axis=1)
    start = _at(c, k)
    if seeded:
        start = np.where(k == 0, np.where(o[:, 0] >= c[:, 0], h[:, 0], c[:, 0]), start)
    base = _at(lo, k)
    return np.maximum(start, _after(h, k, -np.inf, np.max)) - base, base


def drawdown(o: np.ndarray, h: np.ndarray, lo: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(peak, drop since the peak) at the end of the window; the first bar counts with its close."""
    start = c[:, 0]
    top = np.max(h[:, 1:], axis=1) if h.shape[1] > 1 else np.full(len(h), -np.inf)
    higher = top > start
    k = np.where(higher, 1 + np.argmax(h[:, 1:], axis=1) if h.shape[1] > 1 else 0, 0)
    peak = np.where(higher, top, start)
    return peak, peak - np.minimum(_at(c, k), _after(lo, k, np.inf, np.min))


def max_drawdown(o: np.ndarray, h: np.ndarray, lo: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Largest share lost from a running peak; the first bar counts with its high and makes no loss of its own.

    A peak of zero has no share to lose.
    """
    peak, trough, worst = h[:, 0].copy(), c[:, 0].copy(), np.zeros(len(h))
    for j in range(1, h.shape[1]):
        new = h[:, j] > peak
        peak = np.where(new, h[:, j], peak)
        trough = np.where(new, c[:, j], np.minimum(trough, lo[:, j]))
        loss = np.divide(peak - trough, np.abs(peak), out=np.zeros(len(h)), where=peak != 0)
        worst = np.maximum(worst, loss)
    return worst


def first_peak(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Place of the first bar that reaches the window's highest high after its start; the start if none tops its close."""
    if h.shape[1] == 1:
        return np.zeros(len(h), int)
    top = np.max(h[:, 1:], axis=1)
    return np.where(np.abs(top - c[:, 0]) <= 1e-10, 0, 1 + np.argmax(h[:, 1:], axis=1))


FOLDS = ["increase", "inc_base", "window_increase", "peak", "withdrawal", "max_wd", "decrease", "dec_base", "trough", "rebound", "max_rebound", "low_offset", "high_offset", "speed"]


def _folds_of(width: int, lag: int) -> Callable:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_idx", kind="stable")
        n = len(pdf)
        prices = {x: pdf[x].to_numpy(float) for x in ("open", "high", "low", "close")}
        out = {f: np.full(n, np.nan) for f in FOLDS}
        if n >= width:
            o, h, lo, c = (np.lib.stride_tricks.sliding_window_view(prices[x], width) for x in ("open", "high", "low", "close"))
            whole = ~(np.isnan(o) | np.isnan(h) | np.isnan(lo) | np.isnan(c)).any(axis=1)
            at = np.flatnonzero(whole)
            if len(at):
                o, h, lo, c = o[at], h[at], lo[at], c[at]
                got = {}
                got["increase"], got["inc_base"] = rise(o, h, lo, c)
                got["window_increase"], _ = rise(o, h, lo, c, True)
                got["peak"], got["withdrawal"] = drawdown(o, h, lo, c)
                got["max_wd"] = max_drawdown(o, h, lo, c)
                # the falling side is the rising side of negated prices
                fall = (-o, -lo, -h, -c)
                got["decrease"], base = rise(*fall)
                peak, got["rebound"] = drawdown(*fall)
                got["dec_base"], got["trough"] = -base, -peak
                got["max_rebound"] = max_drawdown(*fall)
                got["low_offset"] = width - 1 - np.argmin(lo[:, ::-1], axis=1)
                got["high_offset"] = first_peak(h, c)
                got["speed"] = h.max(axis=1) - h[:, : width - lag].max(axis=1)
                for f, v in got.items():
                    out[f][at + width - 1] = v
        core = pdf["_core"].to_numpy(bool)
        frame = {"key": pdf["key"].to_numpy()[core], "bar_idx": pdf["bar_idx"].to_numpy()[core]}
        return pd.DataFrame(frame | {f: pd.Series(v[core]).astype("Float64") for f, v in out.items()})

    return run


def rolling_folds(bars: DataFrame, key: str, width: int, lag: int = 1) -> DataFrame:
    """All folds over the last ``width`` bars up to each bar, one row per bar: ``key, bar_idx`` and FOLDS.

    increase/inc_base, window_increase (seeded), peak/withdrawal, max_wd, their falling mirrors decrease/dec_base,
    trough/rebound and max_rebound, the window's last lowest low and first highest high as offsets from its start, and
    speed (gain of the highest high over the last ``lag`` bars). Null until the window is full or where it holds a null.
    """
    if not 1 <= lag < width:
        raise ValueError("the lag must be at least 1 and below the width")
    x = blocked(bars.select(F.col(key).alias("key"), "bar_idx", "open", "high", "low", "close"), ["key"], "bar_idx", BLOCK, before=width - 1)
    kind = dict(bars.dtypes)[key]
    schema = f"key {kind}, bar_idx long, " + ", ".join(f"{f} double" for f in FOLDS)
    return by_group(x, "key", "_block").groupBy("key", "_block").applyInPandas(_folds_of(width, lag), schema).withColumnRenamed("key", key)


# --- frames -----------------------------------------------------------------------------------------------------------


def _window(keys: list[str]) -> Window:
    return Window.partitionBy(*keys, "_block").orderBy("bar_idx")


def _core(df: DataFrame) -> DataFrame:
    return df.where("_core").drop("_core", "_block")


def rolling_range_volatility(bars: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``rrv_up, rrv_down``: highest high and lowest low of the last ``width`` bars against the first one's open.

    Null until the window is full, and where the open is 0 or missing.
    """
    x = blocked(bars, keys, "bar_idx", BLOCK, before=width - 1)
    w = _window(keys).rowsBetween(-(width - 1), 0)
    full = F.count(F.lit(1)).over(w) == width
    start = F.first("open").over(w)
    x = x.withColumns({"_o": F.when(full & (start != 0), start), "_h": F.max("high").over(w), "_l": F.min("low").over(w)})
    x = x.withColumns({"rrv_up": (F.col("_h") - F.col("_o")) / F.col("_o"), "rrv_down": (F.col("_o") - F.col("_l")) / F.col("_o")})
    return _core(x.drop("_o", "_h", "_l"))


def range_columns(mode: str) -> list[str]:
    """Columns of a direction mode: up, down or both."""
    modes = {"up": ["rrv_up"], "down": ["rrv_down"], "both": ["rrv_up", "rrv_down"]}
    if mode not in modes:
        raise ValueError(f"direction must be one of {sorted(modes)}, not {mode!r}")
    return modes[mode]


def time_deltas(bars: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """``delta_s``: seconds since the bar before."""
    x = blocked(bars, keys, "bar_idx", BLOCK, before=1)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    return _core(x.withColumn("delta_s", (us - F.lag(us).over(_window(keys))) / 1e6))


def halts(bars: DataFrame, keys: list[str], seconds: int = HALT_SECONDS, ts: str = "ts") -> DataFrame:
    """Runs of bars without volume: ``first_idx, last_idx, from_ts, to_ts, span_s, bars, halted``.

    A run is known by the last bar with volume before it, which is carried over blocks. A null volume ends a run.
    """
    zero = F.coalesce(F.col("volume") == 0, F.lit(False))
    x = bars.withColumns({"_b": F.floor(F.col("bar_idx") / BLOCK), "_v": F.when(~zero, F.col("bar_idx"))})
    x = last_known(x, keys, "_b", ["bar_idx"], "_v", "_run").where(zero).withColumn("_run", F.coalesce("_run", F.lit(-1)))
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    r = x.groupBy(*keys, "_run").agg(F.min("bar_idx").alias("first_idx"), F.max("bar_idx").alias("last_idx"), F.min(ts).alias("from_ts"), F.max(ts).alias("to_ts"), F.count("*").alias("bars"))
    span = (us(F.col("to_ts")) - us(F.col("from_ts"))) / 1e6
    return r.drop("_run").withColumns({"span_s": span, "halted": span >= seconds})


def log_returns(bars: DataFrame, keys: list[str], scale: float = 1.0, ts: str = "ts") -> DataFrame:
    """``ret``: log return to the bar before, null on a day's first bar, in halts, and on the bar after a halt.

    Also ``first_of_day`` and ``in_halt``; prices not above zero make null returns.
    """
    bars = materialize(bars, "bars")
    stops = halts(bars, keys, ts=ts).where("halted").select(*keys, F.explode(F.sequence("first_idx", F.col("last_idx") + 1)).alias("bar_idx"), "last_idx")
    stops = stops.select(*keys, "bar_idx", F.when(F.col("bar_idx") <= F.col("last_idx"), 1).otherwise(2).alias("_stop")).groupBy(*keys, "bar_idx").agg(F.min("_stop").alias("_stop"))
    x = blocked(lookup_join(bars, materialize(stops, "stops"), [*keys, "bar_idx"]), keys, "bar_idx", BLOCK, before=1)
    w = _window(keys)
    logs = F.ln(F.when(F.col("close") > 0, F.col("close")))
    day = F.to_date(ts)
    x = x.withColumns({"_r": logs - F.lag(logs).over(w), "first_of_day": F.coalesce(day != F.lag(day).over(w), F.lit(True)), "in_halt": F.coalesce(F.col("_stop") == 1, F.lit(False))})
    x = x.withColumn("ret", F.when(~F.col("first_of_day") & F.col("_stop").isNull(), F.col("_r") * F.lit(scale)))
    return _core(x.drop("_r", "_stop"))


def forward_variance(returns: DataFrame, keys: list[str], horizon: int, index: str = "ret_idx") -> DataFrame:
    """``rv``: sum of the squares of the next ``horizon`` returns, null where there are fewer. ``index`` numbers the kept rows."""
    x = blocked(returns.withColumnRenamed(index, "bar_idx") if index != "bar_idx" else returns, keys, "bar_idx", BLOCK, after=horizon)
    w = _window(keys).rowsBetween(1, horizon)
    x = x.withColumn("rv", F.when(F.count("ret").over(w) == horizon, F.sum(F.col("ret") * F.col("ret")).over(w)))
    out = _core(x)
    return out.withColumnRenamed("bar_idx", index) if index != "bar_idx" else out


def gap_separators(bars: DataFrame, keys: list[str], factor: float = 2.0, ts: str = "ts") -> DataFrame:
    """Bars with an empty row after every gap longer than ``factor`` times the usual step: ``keys, ts, close, separator``."""
    d = time_deltas(bars, keys, ts)
    usual = d.where("delta_s > 0").groupBy(*keys).agg(F.percentile("delta_s", 0.5).alias("_usual"))
    x = d.join(usual, keys)
    gap = F.col("delta_s") > F.col("_usual") * factor
    at = F.timestamp_micros(F.unix_micros(F.col(ts).cast("timestamp")) - F.round((F.col("delta_s") - F.col("_usual")) * 1_000_000).cast("long")).cast("timestamp_ntz")
    rows = x.where(gap).select(*keys, at.alias(ts), F.lit(None).cast("double").alias("close"), F.lit(True).alias("separator"))
    return bars.select(*keys, ts, "close", F.lit(False).alias("separator")).unionByName(rows)


def to_first_open(bars: DataFrame, keys: list[str], columns: tuple[str, ...] = ("open", "high", "low", "close")) -> DataFrame:
    """Prices with each key's first open as 100."""
    first = bars.groupBy(*keys).agg(F.min_by("open", "bar_idx").alias("_first"))
    x = bars.join(first, keys)
    return x.withColumns({c: F.when(F.col("_first") != 0, F.col(c) / F.col("_first") * 100) for c in columns}).drop("_first")


def only_close(bars: DataFrame) -> DataFrame:
    return bars.withColumns({c: F.col("close") for c in ("open", "high", "low")})


def index_slice(bars: DataFrame, start: int, end: int | None) -> DataFrame:
    """Bars strictly between two positions, numbered anew from 0; ``None`` means up to the last."""
    x = bars.where(F.col("bar_idx") > start)
    x = x if end is None else x.where(F.col("bar_idx") < end)
    return x.withColumn("bar_idx", F.col("bar_idx") - start - 1)


# --- statistics --------------------------------------------------------------------------------------------------------


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


STATS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def range_stats(df: DataFrame, keys: list[str], value: str, spread: str, ts: str = "ts") -> DataFrame:
    """Count, span, mean, deviation (0 for one value), percentiles by linear interpolation and the share above 1 %.

    Percentiles come from multi-select over ``spread`` (an id), so no task holds a key's values.
    """
    x = df.where(finite(value))
    r = x.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end"), F.avg(value).alias("mean"), F.coalesce(F.when(F.count("*") > 1, F.stddev_samp(value)), F.lit(0.0)).alias("std"), F.min(value).alias("min"),
        F.max(value).alias("max"), F.count_if(F.col(value) > 0.01).alias("over_1pct"), F.avg((F.col(value) > 0.01).cast("double")).alias("share_over_1pct"),
    )
    q = interpolated(x, keys, value, STATS, spread).drop("n").withColumnsRenamed({f"q{i}": f"p{int(p * 100):02d}" for i, p in enumerate(STATS)})
    return r.join(q, keys)


def as_metrics(stats: DataFrame, keys: list[str]) -> DataFrame:
    """One row per figure: ``keys, metric, value`` as text."""
    rest = [c for c in stats.columns if c not in keys]
    return stats.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in rest])).alias("m")).select(*keys, "m.*")


def histogram(df: DataFrame, keys: list[str], value: str, spread: str, bins: int = 120) -> DataFrame:
    """Equal bins between the least and greatest value up to 1.05 times the 99.7th percentile: ``bin, lo, hi, n, clipped``.

    Where that percentile is not above zero the largest value stands for it; the bound is at least 1e-6. One value alone
    makes a bin of width one around it, as plotting does.
    """
    x = df.where(finite(value))
    top = x.groupBy(*keys).agg(F.max(value).alias("_m")).join(interpolated(x, keys, value, [0.997], spread).withColumnRenamed("q0", "_p").drop("n"), keys)
    upper = F.greatest(F.when(F.col("_p") > 0, F.col("_p")).otherwise(F.col("_m")) * 1.05, F.lit(1e-6))
    top = top.select(*keys, upper.alias("upper"))
    x = lookup_join(x, materialize(top, "tops"), keys, "inner")
    kept = x.where(F.col(value) <= F.col("upper"))
    ends = kept.groupBy(*keys).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    lo = F.when(F.col("_a") == F.col("_b"), F.col("_a") - 0.5).otherwise(F.col("_a"))
    hi = F.when(F.col("_a") == F.col("_b"), F.col("_b") + 0.5).otherwise(F.col("_b"))
    clipped = x.groupBy(*keys).agg(F.count_if(F.col(value) > F.col("upper")).alias("clipped"))
    ends = ends.select(*keys, lo.alias("_lo"), ((hi - lo) / bins).alias("_w"))
    bin_ = F.least(F.floor((F.col(value) - F.col("_lo")) / F.col("_w")), F.lit(bins - 1))
    n = lookup_join(kept, ends, keys, "inner").withColumn("bin", bin_).groupBy(*keys, "bin", "_lo", "_w").agg(F.count("*").alias("n"))
    return n.join(clipped, keys).select(*keys, "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("lo"), (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("hi"), "n", "clipped")

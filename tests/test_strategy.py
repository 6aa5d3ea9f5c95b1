"""The step machines against a plain second reading of the rules, the always-in chain, and the ledger."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebar.operators import ledger as L
from tidebar.operators.strategy import Machine, Params, run_strategy

from .test_indicators import walk_drop, walk_rise


def series(n, seed, step=0.0006, precision=3):
    rng = np.random.default_rng(seed)
    c = np.round(100 * np.exp(np.cumsum(rng.normal(0, step, n))), precision)
    o = np.r_[c[0], c[:-1]]
    up, down = np.abs(rng.normal(0, step * 40, (2, n)))
    return list(zip(o, np.round(np.maximum(o, c) + up, precision), np.round(np.minimum(o, c) - down, precision), c))


def slow_momentum(bars, p):
    """Entries and exits by re-walking the bars at every step."""
    if p.kind == "short":
        view = [(-o, -lo, -h, -c) for o, h, lo, c in bars]
        sign = -1
    else:
        view, sign = bars, 1
    out, holding = [], False
    armed, fresh, count, last, low, price = False, False, 0, 0, 0, 0.0
    div = lambda a, b: a / abs(b) if b else 0.0
    top = lambda x: max(b[1] for b in x) if x else math.nan

    def lowest(a, b):
        lows = [view[k][2] for k in range(a, b + 1)]
        return max(k for k in range(a, b + 1) if view[k][2] == min(lows))

    for i, (o, _, _, c) in enumerate(view):
        if not holding:
            if fresh:
                last, fresh = i - 1, False
            if count >= p.open_bar:
                last = i - p.open_bar + 1
            count += 1
            if not armed:
                w = view[last : i + 1]
                gain, base = walk_rise(w, False)
                peak, drop = walk_drop(w)
                if not div(drop, peak) < p.open_withdrawal:
                    fresh, count = True, 1
                    continue
                if not div(gain, base) >= p.open_threshold:
                    continue
                low = last = lowest(last, i)
                count, armed = i - low + 1, True
            w = view[low : i + 1]
            peak, drop = walk_drop(w)
            gain, base = walk_rise(w, False)
            enter = False
            if div(drop, peak) < p.open_withdrawal:
                slow = count >= p.open_bar and div(top(w) - top(view[low : max(low, i + 1 - p.open_bar)]), w[0][2]) < p.close_threshold
                price = base
                enter = div(gain, base) >= p.continue_threshold
                if slow:
                    recent = lowest(last, i)
                    last, count, price, armed = recent, i - recent + 1, 0.0, False
            else:
                fresh, count, price, armed = True, 0, 0.0, False
            if enter:
                want = round(sign * price * (1 + sign * p.continue_threshold), p.precision)
                if want * sign < o:
                    want = sign * o
                out.append(("open", i, want))
                holding, fresh, armed, count = True, True, False, i - low
        else:
            fresh = False
            ready = count >= p.close_bar
            count += 1
            w = view[low : i + 1]
            peak, drop = walk_drop(w)
            speed = ready and div(top(w) - top(view[low : max(low, i + 1 - p.close_bar)]), view[i - p.close_bar + 1][2]) < p.close_threshold
            if div(drop, peak) > p.close_withdrawal:
                stop = sign * top(w) * (1 - sign * p.close_withdrawal)
                out.append((1, i, round(sign * min(sign * stop, o), p.precision)))
            elif speed:
                out.append((2, i, round(sign * c, p.precision)))
            else:
                continue
            holding, fresh, count = False, True, 0
    return out


def fast(bars, p):
    m = Machine(p)
    rows = [m.step(*b) for b in bars]
    return [("open" if r["holding_signal"] == 1 else r["close_type"], i, r["execution"]) for i, r in enumerate(rows) if r["execution"] is not None], rows


@pytest.mark.parametrize("kind", ["long", "short"])
@pytest.mark.parametrize("seed", range(25))
def test_momentum_matches_second_reading(kind, seed):
    p = Params(0, kind, 8, 0.001, 0.0012, 0.001, 6, 0.0004 if seed % 2 else 0.0001, 0.0011, 3)
    bars = series(600, seed)
    got, rows = fast(bars, p)
    assert got == slow_momentum(bars, p)
    assert len(got) > 5
    for (kind_, i, price), r in zip(got, [rows[g[1]] for g in got]):
        if kind_ == "open" and r["low_price"]:
            assert price >= bars[i][2] - 1e-9 or kind == "short"


def test_pruning_keeps_results():
    p = Params(0, "long", 8, 0.001, 0.0012, 0.001, 6, 0.0004, 0.0011, 3)
    bars = series(12_000, 3)
    m = Machine(p)
    for b in bars:
        m.step(*b)
    assert m.offset > 0 and fast(bars, p)[0] == slow_momentum(bars, p)


def test_always_in_invariants():
    p = Params(0, "always_in", 8, close_bar=5, close_threshold=0.0004, precision=3)
    bars = series(800, 9)
    got, rows = fast(bars, p)
    opens, closes = [g for g in got if g[0] == "open"], [g for g in got if g[0] != "open"]
    assert {g[0] for g in closes} == {2}
    assert len(opens) == sum(r["have_holding"] == 0 for r in rows)
    assert [o[1] for o in opens[1:]] == [c[1] + 1 for c in closes][: len(opens) - 1]
    for o, c in zip(opens, closes):
        high = [b[1] for b in bars[o[1] : c[1] + 1]]
        assert (max(high) - max(high[:-5])) / bars[c[1] - 4][2] < 0.0004


def test_zero_anchor_option():
    hits = 0
    for seed in range(40):
        bars = series(600, seed)
        for kind in ("long", "short"):
            base = dict(kind=kind, open_bar=4, open_threshold=0.001, continue_threshold=0.001, open_withdrawal=0.001, close_bar=6, close_threshold=0.002, close_withdrawal=0.001, precision=3)
            _, rows = fast(bars, Params(**base))
            hits += sum(r["holding_signal"] == 1 and r["reset_reason"] == "open speed" for r in rows)
            _, rows = fast(bars, Params(**base, zero_anchor="skip"))
            assert not any(r["holding_signal"] == 1 and r["low_price"] == 0 for r in rows)
    assert hits


def frame(spark, sets):
    parts = []
    for name, bars in sets.items():
        pdf = pd.DataFrame(bars, columns=["open", "high", "low", "close"])
        pdf["symbol"], pdf["bar_idx"], pdf["ts"] = name, range(len(pdf)), pd.date_range("2025-01-01", periods=len(pdf), freq="15s")
        parts.append(pdf)
    return spark.createDataFrame(pd.concat(parts)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def slow_ledger(rows, bars, side, capital, commission):
    k, cost, out = capital, None, []
    for r, b in zip(rows, bars):
        if r["holding_signal"] == 1:
            k, cost = k * (1 - commission), r["execution"]
            out.append(k)
        elif r["holding_signal"] == 3:
            out.append(k * (b[3] / cost if side > 0 else cost / b[3]))
        else:
            if cost is not None:
                k, cost = k * (r["execution"] / cost if side > 0 else cost / r["execution"]), None
            out.append(k)
    return out


@pytest.mark.parametrize("kind,side", [("long", 1), ("short", -1)])
def test_batch_ledger_and_trades(spark, kind, side):
    p = Params(4, kind, 8, 0.001, 0.0012, 0.001, 6, 0.0004, 0.0011, 3)
    bad = Params(5, kind, 8, 0.001, 0.0005, 0.001, 6, 0.0004, 0.0011, 3)
    sets = {"a": series(500, 1), "b": series(300, 2)}
    bars = frame(spark, sets)
    signals = run_strategy(bars, [p, bad], "symbol")
    book = L.ledger(signals, ["symbol", "param_id"], side, 50.0, 0.001)
    rows = book.orderBy("symbol", "bar_idx").collect()
    assert {r.param_id for r in rows} == {4}
    for name, b in sets.items():
        want = slow_ledger(fast(b, p)[1], b, side, 50.0, 0.001)
        assert np.allclose([r.capital for r in rows if r.symbol == name], want, rtol=1e-12)
    t = L.trades(book, ["symbol", "param_id"]).orderBy("symbol", "entry_idx").collect()
    assert [(x.entry_idx, x.exit_idx) for x in t if x.symbol == "a"] == list(zip(*[iter(g[1] for g in fast(sets["a"], p)[0])] * 2))
    s = {r.symbol: r for r in L.outcome_stats(book, ["symbol", "param_id"], side).collect()}
    for name in sets:
        cap = [r.capital for r in rows if r.symbol == name]
        k = int(np.argmax(np.array(cap) * side))
        assert s[name].outcome_high == cap[k] and abs(s[name].biggest_back - (cap[k] * side - min(x * side for x in cap[k:]))) < 1e-9


def test_extremes_match_loops(spark):
    p = Params(0, "always_in", 8, close_bar=5, close_threshold=0.0004, precision=3)
    b = series(900, 11)
    bars = frame(spark, {"a": b})
    book = L.ledger(run_strategy(bars, [p], "symbol"), ["symbol", "param_id"])
    t = L.trades(book, ["symbol", "param_id"])
    ext = {r.trade_id: r for r in L.trade_extremes(t, bars, ["symbol", "param_id"], ["symbol"]).collect()}
    way = {r.trade_id: r for r in L.entry_to_max_profit(t, bars, ["symbol", "param_id"], ["symbol"]).collect()}
    for r in t.collect():
        part = b[r.entry_idx : r.exit_idx + 1]
        top = int(np.argmax([x[1] for x in part]))
        dip = int(np.argmin([x[2] for x in part[: top + 1]]))
        e = ext[r.trade_id]
        assert (e.max_profit_idx, e.max_loss_idx, e.holding_bars) == (r.entry_idx + top, r.entry_idx + dip, len(part))
        peak, drop = walk_drop(part[: top + 1])
        w = way[r.trade_id]
        assert w.segment_peak == peak and abs(w.segment_withdrawal - drop) < 1e-12


def test_stream_equals_batch(spark, tmp_path):
    from tidebar.streaming.streams import stream_strategy

    p = Params(0, "long", 8, 0.001, 0.0012, 0.001, 6, 0.0004, 0.0011, 3)
    bars = frame(spark, {"a": series(200, 1), "b": series(150, 2)}).withColumn("ts", F.col("ts").cast("timestamp"))
    for k, cut in enumerate((0, 60, 130)):
        hi = (60, 130, 1000)[k]
        bars.where(f"bar_idx >= {cut} and bar_idx < {hi}").drop("bar_idx").coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    source = spark.readStream.schema(bars.drop("bar_idx").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    q = stream_strategy(source, p).writeStream.format("memory").queryName("signals").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.symbol, r.bar_idx): (r.holding_signal, r.execution, r.period) for r in spark.table("signals").collect()}
    want = {(r.symbol, r.bar_idx): (r.holding_signal, r.execution, r.period) for r in run_strategy(bars.withColumn("ts", F.col("ts").cast("timestamp_ntz")), [p], "symbol").collect()}
    assert got == want

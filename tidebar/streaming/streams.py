"""Bars and strategies over streams."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.strategy import COLUMNS, SIGNAL, Machine, Params


def stream_bars(ticks: DataFrame, seconds: int, late: str = "10 minutes", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """OHLCV bars of a stream of ``ts, seq, px, vol``; ticks later than ``late`` behind the newest are left out.

    ``ts`` must be a timestamp with time zone semantics, as watermarks need one. State is one row per open bar and key.
    """
    x = ticks.withWatermark("ts", late).where("px is not null")
    order = F.struct("ts", "seq")
    return (
        x.groupBy(*keys, F.window("ts", f"{seconds} seconds").alias("w"))
        .agg(F.min_by("px", order).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", order).alias("close"), F.sum("vol").alias("vol_sum"), F.count("*").alias("tick_count"))
        .select(*keys, F.col("w.start").alias("ts"), "open", "high", "low", "close", "vol_sum", "tick_count")
    )


def stream_strategy(bars: DataFrame, params: Params) -> DataFrame:
    """Signals of a stream of finished bars (``symbol, ts, open, high, low, close``), one row per bar.

    The machine's state is kept per symbol between batches; within a batch bars go in order of time, so a batch must not
    hold bars older than those of earlier ones (bars in append mode behind a watermark don't).
    """
    schema = f"symbol string, ts timestamp, bar_idx long, close double, {SIGNAL.format(ts='timestamp')}"
    start = cloudpickle.dumps(Machine(params))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = pickle.loads(state.get[0] if state.exists else start)
        batch = pd.concat(list(frames)).sort_values("ts", kind="stable")
        first = machine.i + 1
        rows = [machine.step(*b) for b in zip(*(batch[c].tolist() for c in ("open", "high", "low", "close", "ts")))]
        state.update((cloudpickle.dumps(machine),))
        out = pd.DataFrame(rows, columns=COLUMNS)
        for c in COLUMNS:
            if c.endswith("_date"):
                out[c] = pd.to_datetime(out[c])
            elif c != "reset_reason":
                out[c] = pd.to_numeric(out[c]).astype("Int64" if f"{c} int" in SIGNAL or f"{c} long" in SIGNAL else "Float64")
        out.insert(0, "symbol", key[0])
        out.insert(1, "ts", batch["ts"].to_numpy())
        out.insert(2, "bar_idx", range(first, first + len(out)))
        out.insert(3, "close", batch["close"].to_numpy())
        yield out

    return bars.groupBy("symbol").applyInPandasWithState(step, schema, "machine binary", "append", GroupStateTimeout.NoTimeout)

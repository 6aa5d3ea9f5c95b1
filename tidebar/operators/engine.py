"""A frame for own strategies: callbacks for flat and held bars, run on every key and parameter set."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import scan_groups

CORE = "have_holding int, holding_signal int, execution double, close_type int"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


@dataclass
class Bar:
    index: int
    open: float
    high: float
    low: float
    close: float
    #: Signal columns of this bar that the strategy fills.
    out: dict = field(default_factory=dict)


@dataclass
class Entry:
    price: float


@dataclass
class Exit:
    price: float
    kind: int


class Strategy(ABC):
    """State lives in attributes; the engine calls, per bar, ``flat`` or ``held``, then ``record``.

    After an entry: ``fill`` gives the price it is made at, then ``opened``. After an exit: ``report``, then ``closed``.
    A bar that closes a position does not open another.
    """

    def __init__(self, params: dict):
        self.params = params

    @classmethod
    def columns(cls) -> str:
        """Further signal columns, e.g. ``"speed double, stage int"``."""
        return ""

    @classmethod
    def defaults(cls) -> dict:
        return {}

    @abstractmethod
    def flat(self, bar: Bar) -> Entry | None: ...

    @abstractmethod
    def held(self, bar: Bar) -> Exit | None: ...

    def fill(self, bar: Bar, entry: Entry) -> float:
        return entry.price

    def opened(self, bar: Bar, price: float) -> None: ...

    def report(self, bar: Bar, done: Exit) -> None: ...

    def closed(self, bar: Bar, done: Exit) -> None: ...

    def record(self, bar: Bar) -> None: ...


class Engine:
    """Drives one strategy; ``step`` gives the signals of a bar. Can be pickled between batches of a stream."""

    def __init__(self, strategy: Strategy):
        self.strategy, self.index, self.holding = strategy, -1, False

    def step(self, o: float, h: float, lo: float, c: float) -> dict:
        self.index += 1
        s = self.strategy
        bar = Bar(self.index, o, h, lo, c, dict(s.defaults()))
        row = {"have_holding": int(self.holding), "holding_signal": 0, "execution": None, "close_type": None}
        if not self.holding:
            if (entry := s.flat(bar)) is not None:
                row["execution"], row["holding_signal"], self.holding = s.fill(bar, entry), 1, True
                s.opened(bar, row["execution"])
        elif (done := s.held(bar)) is not None:
            row["execution"], row["close_type"], self.holding = done.price, done.kind, False
            s.report(bar, done)
            s.closed(bar, done)
        else:
            row["holding_signal"] = 3
        s.record(bar)
        return row | bar.out


def run(bars: DataFrame, make: Callable[[dict], Strategy], sets: list[dict], columns: str, key: str = "symbol") -> DataFrame:
    """Signals of an own strategy: ``key, param_id, bar_idx, ts, close``, the core columns and ``columns``.

    ``make(params)`` builds the strategy for one of ``sets`` (its place is ``param_id``). Keys are scanned in order of
    ``bar_idx``, batch by batch.
    """
    extra = f", {columns}" if columns else ""
    schema = f"_key {dict(bars.dtypes)[key]}, param_id long, bar_idx long, ts timestamp_ntz, close double, {CORE}{extra}"
    names = [(c.split()[0], _ARROW[c.split()[1]]) for c in f"{CORE}{extra}".split(", ")]
    x = bars.select(F.col(key).alias("_key"), "bar_idx", "ts", "open", "high", "low", "close")
    x = x.withColumn("param_id", F.explode(F.array(*[F.lit(i).cast("long") for i in range(len(sets))])))

    def start(piece: pa.Table) -> Engine:
        return Engine(make(sets[piece["param_id"][0].as_py()]))

    def step(engine: Engine, piece: pa.Table) -> pa.Table:
        rows = [engine.step(*b) for b in zip(*(piece[c].to_pylist() for c in ("open", "high", "low", "close")))]
        return pa.table({c: piece[c] for c in ("_key", "param_id", "bar_idx", "ts", "close")} | {n: pa.array([r.get(n) for r in rows], t) for n, t in names})

    return scan_groups(x, ["_key", "param_id"], "bar_idx", start, step, schema).withColumnRenamed("_key", key)

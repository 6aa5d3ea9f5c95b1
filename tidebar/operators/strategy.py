"""Path-dependent entry and exit machines over bars, in batch and as a step function for streams.

A machine sees one bar at a time and keeps what it needs: running extremes since its anchor, and the bars back to that
anchor. The short side is the long side on negated prices. A group is one symbol under one parameter set; the machines
cannot be cut in time, since every decision depends on those before, so sweeps and symbols are the parallel axes.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scale import scan_groups
from .indicators import first_peak, max_drawdown, rise


@dataclass(frozen=True)
class Params:
    """One parameter set. ``kind``: long, short, always_in, or legacy (the older long rules)."""

    param_id: int = 0
    kind: str = "long"
    open_bar: int = 12
    open_threshold: float = 0.002
    continue_threshold: float = 0.002
    open_withdrawal: float = 0.0013
    close_bar: int = 12
    close_threshold: float = 0.001
    close_withdrawal: float = 0.0013
    precision: int = 5
    #: A bar that resets for lack of speed and opens at once has no anchor price: it opens all the same, or not (``skip``).
    zero_anchor: str = "open"

    def usable(self) -> bool:
        """Thresholds fit together; other sets are passed over in a sweep."""
        if self.kind in ("always_in", "legacy"):
            return True
        return self.open_withdrawal <= self.open_threshold <= self.continue_threshold and self.close_withdrawal <= self.continue_threshold


# fixed values: shipped parameter sets, windows in minutes, thresholds as shares
SHIPPED = {
    "long": {"minutes": 50, "open_threshold": 0.0020, "continue_threshold": 0.0020, "open_withdrawal": 0.0013, "close_threshold": 0.001, "close_withdrawal": 0.0013},
    "short": {"minutes": 10, "open_threshold": 0.0013, "continue_threshold": 0.0013, "open_withdrawal": 0.0013, "close_threshold": 0.0001, "close_withdrawal": 0.0013},
    "always_in": {"minutes": 10, "open_threshold": 0.0001, "continue_threshold": 0.0013, "close_threshold": 0.001},
}


def minutes_to_bars(minutes: float, seconds: int) -> int:
    """Nearest number of bars, at least one; halves go to the even number."""
    return max(1, round(minutes * 60 / seconds))


def minutes_to_bars_down(minutes: float, seconds: int) -> int:
    return int(minutes * 60 / seconds)


#: The signal columns; dates have the type of the bars' times.
SIGNAL = (
    "have_holding int, holding_signal int, execution double, close_type int, reset_reason string, withdrawal double, wd_per double, wd_signal int, increase double, inc_per double, inc_signal int, "
    "ana_inc double, a_inc_per double, total_inc double, t_inc_per double, total_inc_signal int, max_inc double, max_wd double, holding_wd double, hld_wd_per double, holding_wd_signal int, holding_inc double, "
    "speed_close_signal int, period int, low_index long, high_index long, low_price double, high_price double, last_index long, new_opening_count int, low_date {ts}, high_date {ts}"
)
COLUMNS = [c.split()[0] for c in SIGNAL.split(", ")]


def ratio(x: float, base: float) -> float:
    return x / abs(base) if base != 0 else 0.0


class Since:
    """Extremes of the bars since an anchor, updated bar by bar."""

    def __init__(self) -> None:
        self.tops: list[float] = []

    def push(self, h: float, lo: float, c: float) -> None:
        if not self.tops:
            self.base, self.best, self.peak, self.trough = lo, c, c, c
            self.first_low, self.base_at = lo, 0
            self.tops.append(h)
            return
        if lo <= self.base:
            self.base, self.best, self.base_at = lo, c, len(self.tops)
        elif h > self.best:
            self.best = h
        if h > self.peak:
            self.peak, self.trough = h, c
        elif lo < self.trough:
            self.trough = lo
        top = self.tops[-1]
        self.tops.append(h if h > top else top)

    @property
    def rise(self) -> float:
        return self.best - self.base

    @property
    def drop(self) -> float:
        return self.peak - self.trough

    def gain(self, bars: int) -> float:
        """Rise of the highest high over the last bars; NaN if the anchor is not that far back."""
        at = len(self.tops) - 1 - bars
        return self.tops[-1] - self.tops[at] if at >= 0 else math.nan


class Machine:
    """State of one symbol under one parameter set; ``step`` takes a bar and gives the row of signals."""

    def __init__(self, p: Params):
        self.p = p
        self.side = -1.0 if p.kind == "short" else 1.0
        self.i = -1
        self.offset = 0
        self.bars: list[tuple[float, float, float, float]] = []
        self.times: list = []
        self.holding = False
        self.fresh = False
        self.count = 0
        self.stage = 0
        self.last = 0
        self.low = 0
        self.anchor_price = 0.0
        self.entered = 0
        self.since = Since()

    # bars are kept as the long side sees them
    def _window(self, a: int, b: int) -> tuple[np.ndarray, ...]:
        part = np.array(self.bars[a - self.offset : b + 1 - self.offset])
        return tuple(part[:, k][None, :] for k in range(4))

    def _forget(self) -> None:
        need = min(self.last, self.i - max(self.p.open_bar, self.p.close_bar) - 1)
        if self.holding or self.stage == 2:
            need = min(need, self.low)
        if need - self.offset > 4096:
            del self.bars[: need - self.offset], self.times[: need - self.offset]
            self.offset = need

    def date_of(self, index: int | None):
        """Time of an earlier bar; a bar's own time is not known yet while it is judged."""
        return None if index is None or index >= self.i else self.times[index - self.offset]

    def step(self, o: float, h: float, lo: float, c: float, ts: object = None) -> dict:
        self.i += 1
        row = dict.fromkeys(COLUMNS)
        row |= {"holding_signal": 0, "wd_signal": 0, "inc_signal": 0, "total_inc_signal": 0, "holding_wd_signal": 0, "speed_close_signal": 0}
        self.bars.append((o, h, lo, c) if self.side > 0 else (-o, -lo, -h, -c))
        self.times.append(ts)
        row["have_holding"] = int(self.holding)
        if self.holding:
            self._hold(row)
        elif self.p.kind == "always_in":
            self._enter_always(row)
        else:
            self._wait(row)
        row["last_index"], row["new_opening_count"] = self.last, self.count
        row["low_date"], row["high_date"] = self.date_of(row["low_index"]), self.date_of(row["high_index"])
        self._forget()
        return row

    def _price(self, x: float) -> float:
        return round(self.side * x, 2 if self.p.kind == "legacy" else self.p.precision)

    # --- flat ---------------------------------------------------------------------------------------------------------

    def _wait(self, row: dict) -> None:
        p, i = self.p, self.i
        legacy = p.kind == "legacy"
        if self.fresh:
            self.last, self.fresh = i - 1, False
        if self.count >= p.open_bar:
            self.last = i - p.open_bar + 1
        self.count += 1
        if self.stage == 0 and not self._arm(row, legacy):
            return
        # armed: the anchor is the window's last lowest low
        _, h, lo, c = self.bars[-1]
        if len(self.since.tops) < i - self.low + 1:
            self.since.push(h, lo, c)
        s = self.since
        row["withdrawal"] = s.drop
        calm = ratio(s.drop, s.peak) < p.open_withdrawal
        row["wd_signal"] = int(calm)
        slow = False
        if calm:
            if self.count >= p.open_bar:
                gain = s.gain(p.open_bar)
                share = ratio(gain, s.first_low)
                row["ana_inc"] = gain
                row["a_inc_per"] = share * 100 if legacy else _round(share * 100)
                slow = share < p.close_threshold
            base = s.first_low if legacy else s.base
            share = ratio(s.rise, base)
            row["total_inc"], row["t_inc_per"] = s.rise, _round(share * 100)
            self.anchor_price = base
            row["total_inc_signal"] = int(share >= p.continue_threshold)
        else:
            self._report(row, "open withdraw")
            self.fresh, self.stage, self.count, self.anchor_price = True, 0, 0, 0.0
        if slow:
            self._report(row, "open speed")
            _, _, lows, _ = self._window(self.last, i)
            recent = i - int(np.argmin(lows[0][::-1]))
            self.last, self.stage, self.count, self.anchor_price = recent, 0, i - recent + 1, 0.0
        if row["total_inc_signal"] and not (p.zero_anchor == "skip" and self.anchor_price == 0):
            self._open(row)

    def _arm(self, row: dict, legacy: bool) -> bool:
        """Test the window for speed and calm; on success anchor at its last lowest low."""
        p, i = self.p, self.i
        seen = Since()
        for _, h, lo, c in self.bars[self.last - self.offset :]:
            seen.push(h, lo, c)
        rose, peak, drop = seen.rise, seen.peak, seen.drop
        share = ratio(rose, seen.first_low if legacy else seen.base)
        lost = ratio(drop, peak)
        row |= {"withdrawal": drop, "wd_per": _round(lost * 100), "increase": rose, "inc_per": _round(share * 100)}
        fast, calm = share >= p.open_threshold, legacy or lost < p.open_withdrawal
        row["inc_signal"], row["wd_signal"] = int(fast), int(calm)
        if not calm:
            self.fresh, self.count = True, 1
            return False
        if not fast:
            return False
        self.low = self.last = self.last + seen.base_at
        self.since = Since()
        for _, h, lo, c in self.bars[self.low - self.offset :]:
            self.since.push(h, lo, c)
        self.count = i - self.low + 1
        self.stage = 2
        row["low_index"], row["period"] = self.low, self.count
        return True

    def _open(self, row: dict) -> None:
        p, i = self.p, self.i
        o = self.bars[-1][0]
        price = round(self.side * self.anchor_price * (1 + self.side * p.continue_threshold), 2 if p.kind == "legacy" else p.precision)
        # a gap beyond the wanted price fills at the open
        if price * self.side < o:
            price = self.side * o
        row |= {"execution": price, "holding_signal": 1, "low_price": self.side * self.anchor_price + 0.0, "low_index": self.low}
        self.holding, self.fresh, self.stage = True, True, 0
        self.count = i - self.low

    def _enter_always(self, row: dict) -> None:
        p, i = self.p, self.i
        row |= {"total_inc": 0.0, "t_inc_per": 0.0, "total_inc_signal": 1, "inc_signal": 1, "wd_signal": 1, "period": 1, "low_index": i}
        if p.open_bar > 1 and i + 1 >= p.open_bar:
            rose, base = (float(x[0]) for x in rise(*self._window(i + 1 - p.open_bar, i)))
            row["total_inc"], row["t_inc_per"] = rose, _round(ratio(rose, base) * 100)
        o, h, lo, c = self.bars[-1]
        self.low, self.anchor_price, self.count = i, o, 1
        self.since = Since()
        self.since.push(h, lo, c)
        row |= {"execution": self._price(o), "holding_signal": 1, "low_price": o}
        self.holding, self.fresh = True, True

    # --- in position --------------------------------------------------------------------------------------------------

    def _hold(self, row: dict) -> None:
        p, i, s = self.p, self.i, self.since
        o, h, lo, c = self.bars[-1]
        if self.fresh:
            self.last, self.entered, self.fresh = self.low, i, False
        ready = self.count >= p.close_bar
        if ready:
            self.last = i - p.close_bar
        self.count += 1
        if p.kind == "legacy":
            ready = self.count >= p.close_bar
        s.push(h, lo, c)
        if ready:
            gain = s.gain(p.close_bar)
            base = self.bars[self.last + 1 - self.offset][2]
            row["holding_inc"] = gain
            row["speed_close_signal"] = int(ratio(gain, base) < p.close_threshold)
        lost = ratio(s.drop, s.peak)
        row |= {"holding_wd": s.drop, "hld_wd_per": _round(lost * 100), "high_price": self.side * s.tops[-1]}
        if p.kind in ("long", "short"):
            row["holding_wd_signal"] = int(lost > p.close_withdrawal)
        if row["holding_wd_signal"]:
            # the price at which the loss reaches its bound, or the open beyond it
            stop = self.side * s.tops[-1] * (1 - self.side * p.close_withdrawal)
            self._close(row, 1, self._price(min(self.side * stop, o)))
        elif row["speed_close_signal"]:
            self._close(row, 2, self.side * c if p.kind == "legacy" else self._price(c))
        else:
            row["holding_signal"] = 3

    def _close(self, row: dict, kind: int, price: float) -> None:
        period = self.i - self.entered + 1
        self._report(row, None)
        row |= {"holding_signal": 0, "execution": price, "close_type": kind, "period": period}
        self.holding, self.fresh, self.count = False, True, 0

    def _report(self, row: dict, reason: str | None) -> None:
        """What the stretch from the anchor to its highest high brought and cost."""
        o, h, lo, c = self._window(self.low, self.i)
        top = int(first_peak(h, c)[0])
        part = tuple(x[:, : top + 1] for x in (o, h, lo, c))
        rose, base = (float(x[0]) for x in rise(*part))
        worst = float(max_drawdown(*part)[0])
        if self.p.kind == "legacy":
            share = round(ratio(rose, float(part[2][0, 0])), 5) * 100
            worst = round(worst, 5) * 100
        else:
            share, worst = _round(ratio(rose, base) * 100), _round(worst * 100)
        row |= {"max_inc": share, "max_wd": worst, "high_index": self.low + top, "low_index": self.low, "period": self.count, "reset_reason": reason}


def _round(x: float) -> float:
    return round(x, 4) if math.isfinite(x) else x


def parameters(spark: SparkSession, sets: list[Params]) -> DataFrame:
    """Parameter sets as a table; sets that do not fit together are left out."""
    kinds = {int: "long", float: "double", str: "string", "int": "long", "float": "double", "str": "string"}
    schema = ", ".join(f"{f.name} {kinds[f.type]}" for f in fields(Params))
    return spark.createDataFrame([tuple(asdict(p).values()) for p in sets if p.usable()], schema)


def run_strategy(bars: DataFrame, sets: list[Params], key: str = "symbol") -> DataFrame:
    """Signals of every bar under every parameter set: ``key, param_id, bar_idx, ts`` and the signal columns.

    ``bars``: ``key, bar_idx, ts, open, high, low, close`` without null prices (drop faulty bars before). ``low_date`` and ``high_date`` are null where they point at the bar itself, whose time is not
    known yet when they are written. Sets are broadcast, being given as a list.
    """
    spark = bars.sparkSession
    by_id = {p.param_id: p for p in sets if p.usable()}
    kind = dict(bars.dtypes)[key]
    ids = F.explode(F.array(*[F.lit(i).cast("long") for i in by_id])) if by_id else F.lit(None).cast("long")
    x = bars.select(F.col(key).alias("_key"), "bar_idx", "ts", "open", "high", "low", "close").withColumn("param_id", ids)
    if not by_id:
        x = x.limit(0)
    schema = f"_key {kind}, param_id long, bar_idx long, ts timestamp_ntz, close double, {SIGNAL.format(ts='timestamp_ntz')}"
    arrow = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "{ts}": pa.timestamp("us")}
    types = [arrow[c.split()[1]] for c in SIGNAL.split(", ")]

    def start(piece: pa.Table) -> Machine:
        return Machine(by_id[piece["param_id"][0].as_py()])

    def step(machine: Machine, piece: pa.Table) -> pa.Table:
        bars = zip(*(piece[c].to_pylist() for c in ("open", "high", "low", "close", "ts")))
        rows = [tuple(machine.step(*b).values()) for b in bars]
        signals = {c: pa.array(v, t) for c, v, t in zip(COLUMNS, zip(*rows), types)}
        return pa.table({c: piece[c] for c in ("_key", "param_id", "bar_idx", "ts", "close")} | signals)

    return scan_groups(x, ["_key", "param_id"], "bar_idx", start, step, schema).withColumnRenamed("_key", key)

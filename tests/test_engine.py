from tidebar.operators.engine import Entry, Exit, Strategy, run
from tidebar.operators.indicators import range_columns

import pytest

from .test_strategy import frame, series


class TwoUp(Strategy):
    """Buys after two rising closes, sells after ``hold`` bars."""

    def __init__(self, params):
        super().__init__(params)
        self.closes, self.age, self.log = [], 0, []

    @classmethod
    def defaults(cls):
        return {"ups": 0}

    def flat(self, bar):
        ups = [b > a for a, b in zip(self.closes[-2:], [*self.closes[-1:], bar.close])]
        bar.out["ups"] = sum(ups)
        return Entry(bar.close) if len(ups) == 2 and all(ups) else None

    def held(self, bar):
        self.age += 1
        return Exit(bar.open, 2) if self.age == self.params["hold"] else None

    def fill(self, bar, entry):
        return round(entry.price, 2)

    def opened(self, bar, price):
        self.age = 0
        self.log.append("opened")

    def report(self, bar, done):
        self.log.append("report")

    def closed(self, bar, done):
        assert self.log[-1] == "report"
        self.log.append("closed")

    def record(self, bar):
        self.closes.append(bar.close)
        bar.out["calls"] = len(self.log)


def test_own_strategy(spark):
    b = series(80, 4)
    got = run(frame(spark, {"a": b, "b": b[:30]}), TwoUp, [{"hold": 3}, {"hold": 5}], "ups int, calls int").collect()
    assert len(got) == 2 * (80 + 30)
    for sym, n in (("a", 80), ("b", 30)):
        for pid, hold in ((0, 3), (1, 5)):
            rows = sorted((r for r in got if r.symbol == sym and r.param_id == pid), key=lambda r: r.bar_idx)
            opens = [r.bar_idx for r in rows if r.holding_signal == 1]
            exits = [r.bar_idx for r in rows if r.close_type == 2]
            assert opens and exits == [o + hold for o in opens][: len(exits)]
            assert all(rows[x].execution == b[x][0] for x in exits) and all(r.have_holding == 1 for r in rows if r.close_type)
            assert rows[-1].calls == len(opens) + 2 * len(exits) and len(rows) == n


def test_modes():
    assert range_columns("both") == ["rrv_up", "rrv_down"]
    with pytest.raises(ValueError):
        range_columns("sideways")

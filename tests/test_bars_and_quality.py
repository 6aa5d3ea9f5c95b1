from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidebar.operators import bars as B
from tidebar.operators import quality as Q
from tidebar.operators.strategy import minutes_to_bars, minutes_to_bars_down

from .test_indicators import SIX


def test_sessions(spark):
    t = spark.createDataFrame([(datetime(2024, 1, 5, 18), ), (datetime(2024, 1, 5, 17, 59, 59),)], "ts timestamp_ntz")
    r = t.select(B.session_date(F.col("ts")).alias("s"), B.in_closed_hour(F.col("ts")).alias("c")).collect()
    assert [tuple(x) for x in r] == [(date(2024, 1, 6), False), (date(2024, 1, 5), True)]


def test_times(spark):
    t = spark.createDataFrame([("20250101 180005123",), ("20250101 180005",), ("x",), ("20251301 000000000",)], "t string")
    assert [r[0] for r in t.select(B.compact_time(F.col("t"))).collect()] == [datetime(2025, 1, 1, 18, 0, 5, 123000), datetime(2025, 1, 1, 18, 0, 5), None, None]


def test_bars_fill_and_ties(spark):
    rows = [("x", datetime(2025, 1, 1, 10, 0, 0), 2, 5.0, 1.0), ("x", datetime(2025, 1, 1, 10, 0, 0), 1, 4.0, 1.0), ("x", datetime(2025, 1, 1, 10, 3, 30), 3, 6.0, None), ("x", None, 4, 9.0, 1.0), ("x", datetime(2025, 1, 1, 10, 2, 0), 5, None, 1.0)]
    t = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, seq long, px double, vol double")
    b = B.filled_bars(t, 60).orderBy("ts").collect()
    assert [(r.ts.minute, r.open, r.close, r.volume) for r in b] == [(0, 4, 5, 2), (1, 5, 5, 0), (2, 5, 5, 0), (3, 6, 6, 0), (4, 6, 6, 0)]
    assert B.filled_bars(t.limit(0), 60).count() == 0
    with pytest.raises(ValueError):
        B.tick_bars(t, 7)
    with pytest.raises(ValueError):
        B.price("last")


def test_roles_and_policies(spark):
    df = spark.createDataFrame([(x[2], x[3], x[1], x[0]) for x in SIX], "c1 double, c2 double, c3 double, c4 double")
    roles = Q.detect_roles(df, ["c1", "c2", "c3", "c4"])
    assert (roles["low"], roles["high"], roles["open"], roles["close"]) == ("c1", "c3", "c2", "c4")
    junk = spark.createDataFrame([(1.0, None, None, 2.0)] * 5, "c1 double, c2 double, c3 double, c4 double")
    with pytest.raises(ValueError):
        Q.detect_roles(junk, ["c1", "c2", "c3", "c4"])

    def table(bad):
        return spark.createDataFrame([(datetime(2025, 1, 1), 1.0, 2.0, 3.0 if i < bad else 0.5, 1.0) for i in range(100)], "ts timestamp_ntz, open double, high double, low double, close double")

    assert Q.apply_bad_bar_policy(table(5)).count() == 100
    assert Q.apply_bad_bar_policy(table(5), "drop").count() == 95
    for bad, policy in ((6, "keep"), (1, "fail")):
        with pytest.raises(ValueError):
            Q.apply_bad_bar_policy(table(bad), policy)


def test_small_rules(spark):
    t = spark.createDataFrame([("abc_XAGUSD_1.csv",), ("gold-xau.csv",), ("x.csv",)], "n string")
    assert [r[0] for r in t.select(Q.infer_symbol(F.col("n"))).collect()] == ["XAG", "XAU", "UNK"]
    d = spark.createDataFrame([(1.5,), (100.0,), (2e-5,), (0.00010,)], "v double")
    assert [r[0] for r in d.select(Q.decimals(F.col("v"))).collect()] == [1, 0, 5, 4]
    s = spark.createDataFrame([(15,), (90,), (7200,), (172800,)], "s long")
    assert [tuple(r) for r in s.select(Q.period_label(F.col("s")), Q.exact_period_label(F.col("s"))).collect()] == [("15s", "15s"), ("1min", "90s"), ("2h", "2h"), ("2d", "48h")]
    assert (minutes_to_bars(50, 15), minutes_to_bars(0.1, 60), minutes_to_bars_down(1.9, 60)) == (200, 1, 1)

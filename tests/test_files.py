import zipfile

import pytest
from pyspark.sql import functions as F

from tidebar.sources import files, sinks

from .test_indicators import SIX


def test_bars_in_any_order(spark, tmp_path):
    (tmp_path / "b.csv").write_text("".join(f"2025-01-01 10:{i:02d}:00,{x[2]},{x[3]},{x[1]},{x[0]},7\n" for i, x in enumerate(SIX)) + "2025-01-01 11:00:00,1,x,3,2,7\n")
    rows = files.read_bars_csv(spark, str(tmp_path / "b.csv")).orderBy("ts").collect()
    assert rows[0].low == 99 and rows[0].high == 101 and rows[-1].open is None


def test_klines_with_and_without_header(spark, tmp_path):
    body = "2025-01-01 10:00:00{s}1{s}2{s}0.5{s}1.5{s}9\nbad{s}1{s}2{s}0.5{s}1.5{s}9\n2025-01-01 10:01:00{s}1{s}2{s}0.5{s}0{s}9\n"
    for k, (sep, head) in enumerate(((",", "DateTime , Open,HIGH,low,close,volume\n"), ("\t", ""), (";", "datetime;open;high;low;close;volume\n"))):
        p = tmp_path / f"k{k}.csv"
        p.write_text(head + body.format(s=sep))
        r = files.read_kline_csv(spark, str(p)).collect()
        assert len(r) == 1 and (r[0].open, r[0].close, r[0].volume) == (1, 1.5, 9)
    (tmp_path / "e.csv").write_text("datetime,open,high,low,close,x\n1,2,3,4,5,6\n")
    with pytest.raises(ValueError):
        files.read_kline_csv(spark, str(tmp_path / "e.csv"))


def test_ticks_of_four_and_five_columns(spark, tmp_path):
    (tmp_path / "four.csv").write_text("20250101 100000000,1,2,3\n20250101 100001000,1,2\n1,2,3,4,5,6,7\n")
    (tmp_path / "five.csv").write_text("20250101,100000000,1,2,3\n")
    four = files.read_ticks_csv(spark, str(tmp_path / "four.csv")).orderBy("seq").collect()
    assert [(r.dt, r.bid, r.vol) for r in four] == [("20250101 100000000", "1", "3"), ("20250101 100001000", "1", None)]
    assert [(r.dt, r.bid, r.ask, r.vol) for r in files.read_ticks_csv(spark, str(tmp_path / "five.csv")).collect()] == [("20250101 100000000", "1", "2", "3")]


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("b.csv", "no\n")
        z.writestr("DAT_ASCII_x.csv", "one\ntwo\n")
    assert [r.line for r in files.read_zipped_lines(spark, str(tmp_path)).orderBy("line_no").collect()] == ["one", "two"]
    with pytest.raises(ValueError):
        files.choose_member(["a.pdf"])
    with pytest.raises(ValueError):
        files.read_zipped_lines(spark, str(tmp_path), "*.rar")


def test_catalog(spark, tmp_path):
    for name in ("x/First_Run.html", "y/second.html", ".git/no.html", "y/other.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("<p>")
    c = files.file_catalog(spark, str(tmp_path))
    assert {(r.token, r.folder, r.display) for r in c.collect()} == {("x/First_Run.html", "x", "First Run"), ("y/second.html", "y", "second")}
    assert files.search(c, "RUN").count() == 1 and files.search(c, "y").count() == 1 and files.page(c, 1).count() == 2
    t = spark.createDataFrame([("a%20b.html",), ("../a.html",), ("a/..%2Fb.html",), ("/a.html",), ("a.txt",)], "t string")
    assert [r[0] for r in t.select(files.safe_path(F.col("t"))).collect()] == [True, False, False, False, False]


def test_sinks(spark, tmp_path):
    b = spark.createDataFrame([(f"2025-0{m}-01 00:00:00", float(m)) for m in (3, 1, 2)], "ts string, close double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    sinks.write_monthly_bars(b, str(tmp_path / "m"))
    assert {p.name for p in (tmp_path / "m").iterdir() if p.is_dir()} == {"month=2025-01", "month=2025-02", "month=2025-03"}
    sinks.write_all_bars(b, str(tmp_path / "all"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "all").glob("*.csv")))
    assert [x[:7] for x in text.split()[::2]] == ["2025-01", "2025-02", "2025-03"]
    sinks.write_results(b.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    m = spark.createDataFrame([("90", "up", "mean", "1")], "period string, direction string, metric string, value string")
    for _ in range(2):
        sinks.append_range_stats(m, str(tmp_path / "s"))
    both = spark.read.parquet(str(tmp_path / "s"))
    assert both.count() == 2 and {r.sheet for r in both.collect()} == {1, 2}
    one = spark.createDataFrame([(1, 2.5)], "param_id int, capital double")
    assert not sinks.write_sweep_stats(one, str(tmp_path / "sweep")) and not (tmp_path / "sweep").exists()
    assert sinks.write_sweep_stats(one.unionAll(one.selectExpr("2", "capital")), str(tmp_path / "sweep")) and spark.read.parquet(str(tmp_path / "sweep")).count() == 2
    sinks.write_trade_stats(one, one, str(tmp_path / "t"))
    assert {p.name for p in (tmp_path / "t").iterdir()} == {"stats", "trades"}
    name = sinks.write_parameters(one, str(tmp_path), "XAGUSD", "30s")
    assert spark.read.json(f"{tmp_path}/{name}").first().capital == 2.5

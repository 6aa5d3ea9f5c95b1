"""Line loading against a character-by-character reader."""

import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidebar.operators.rejects import REASONS, check_lines, load_tick_lines

NUMBER = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?", re.A)


def value(text):
    return float(text) if NUMBER.fullmatch(text) and math.isfinite(float(text)) else None


def slow(line, sep):
    line = (line or "").rstrip("\r\n")
    blanks = " " if sep == "\t" else " \t"
    cells, cell, inside = [], "", False
    for ch in line:
        inside ^= ch == '"'
        if ch == sep and not inside:
            cells.append(cell)
            cell = ""
        else:
            cell += ch
    cells.append(cell)
    if inside:
        return "quoting"
    out = []
    for c in cells:
        c = c.strip(blanks)
        if len(c) >= 2 and c[0] == c[-1] == '"' and c.count('"') == 2:
            c = c[1:-1].strip(blanks)
        elif '"' in c:
            return "quoting"
        out.append(c)
    if len(out) != 4:
        return "columns"
    for name, c in zip(("bid", "ask"), out[1:3]):
        v = value(c)
        if v is None or v <= 0:
            return name
    v = value(out[3])
    return "vol" if out[3] and (v is None or v < 0) else None


def check(lines, sep):
    reason, _ = check_lines(pa.array(lines, pa.string()), ord(sep))
    return [None if r < 0 else REASONS[r] for r in reason.tolist()]


def test_matches_slow_reader(spark, small):
    df = spark.read.parquet(f"{small}/tick_line.parquet")
    rows = df.select("line_id", "file_id", "line").collect()
    votes = defaultdict(Counter)
    for r in rows:
        for sep in ",\t":
            votes[r.file_id][sep] += (r.line or "").count(sep) == 3
    got = {r.line_id: r.reason for r in load_tick_lines(df).collect()}
    assert got == {r.line_id: slow(r.line, "\t" if votes[r.file_id]["\t"] > votes[r.file_id][","] else ",") for r in rows}


piece = st.sampled_from(["1", "2.5", "-3", "1e3", "+4", "", " ", "\t", '"', '"5"', '"6', "x", "inf", "nan", ".", "7.", ".5", "٣", "é", "1e400"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.lists(piece, max_size=2).map("".join), max_size=6)), max_size=8), st.sampled_from(",\t"))
def test_any_lines(rows, sep):
    lines = [None if r is None else sep.join(r) for r in rows]
    assert check(lines, sep) == [slow(x, sep) for x in lines]


def test_values_and_edges(spark):
    rows = [(1, 1, "d,1.5,2,3"), (2, 1, 'd," 1.5 ","2",'), (3, 1, None), (4, 1, ""), (5, 1, "d,1,2," + "9" * 200_000), (6, None, "d,1,2,3"), (7, 1, "d,3,2,1\r\n"), (7, 1, "d,3,2,1\r\n")]
    df = spark.createDataFrame([(*r, "clash", 1.0, True) for r in rows], "line_id long, file_id long, line string, reason string, bid double, tab boolean")
    got = sorted(load_tick_lines(df).collect(), key=lambda r: r.line_id)
    assert [r.reason for r in got] == [None, None, "columns", "columns", "vol", None, None, None]
    assert (got[0].bid, got[0].ask, got[0].vol) == (1.5, 2.0, 3.0) and got[1].vol is None and got[1].bid == 1.5
    assert load_tick_lines(df.limit(0)).count() == 0

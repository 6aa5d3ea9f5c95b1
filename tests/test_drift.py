from random import Random

from tidebar.operators.drift import drift_changes, drift_table, edit_script, tree


def script(old, new):
    return sorted(edit_script(tree(old), tree(new))[1])


def test_scripts():
    old = [("dt", "timestamp"), ("bid", "decimal"), ("vol", "integer")]
    assert script(old, [("bid", "decimal"), ("vol", "integer"), ("dt", "timestamp")]) == []
    assert script(old, [("dt", "timestamp"), ("bid_px", "decimal"), ("vol", "decimal")]) == [("renamed", "bid", "bid_px"), ("retyped", "vol", "vol")]
    assert script(old, [("dt", "timestamp"), ("bid", "decimal"), ("flag", "boolean")]) == [("added", "flag", "flag"), ("removed", "vol", "vol")]
    assert script([("high", "decimal"), ("low", "decimal")], [("high_px", "decimal"), ("low_px", "decimal")]) == [("renamed", "high", "high_px"), ("renamed", "low", "low_px")]


def test_nested():
    old = [("quote.bid", "decimal"), ("quote.ask", "decimal"), ("id", "integer")]
    assert script(old, [("quote.bid", "decimal"), ("quote.ask", "text"), ("id", "integer")]) == [("retyped", "quote.ask", "quote.ask")]
    assert ("renamed", "quote", "q") in script(old, [("q.bid", "decimal"), ("q.ask", "decimal"), ("id", "integer")])


def test_moves(spark):
    old = [("quote.bid", "decimal"), ("quote.ask", "decimal"), ("top.n", "integer")]
    new = [("quote.ask", "decimal"), ("top.n", "integer"), ("top.bid", "decimal")]
    assert script(old, new) == [("moved", "quote.bid", "top.bid")]
    assert script(old, [*new[:2], ("top.bid", "text")]) == [("added", "top.bid", "top.bid"), ("removed", "quote.bid", "quote.bid")]
    assert script([("quote.bid", "decimal"), ("n", "integer")], [("bid", "decimal"), ("n", "integer")]) == [("moved", "quote.bid", "bid"), ("removed", "quote", "quote")]
    f, lines = files(spark, [("2025-01-01", ["quote.bid,quote.ask,top.n", "1.5,1.6,3"]), ("2025-01-02", ["quote.ask,top.n,top.bid", "1.7,4,1.6"])])
    assert [(r.change_kind, r.field_name) for r in drift_changes(f, lines).collect()] == [("moved", "top.bid")]
    rows = {r.line_id: r.asDict() for r in drift_table(f, lines).collect()}
    assert rows[3] == {"line_id": 3, "file_id": 1, "stream_id": 1, "line_no": 2, "quote.ask": 1.7, "top.n": 4, "quote.bid": 1.6, "extra": {}}


def test_wide_leftovers_are_paired_at_least_cost():
    from functools import lru_cache
    from tidebar.operators.drift import _likeness

    for seed in range(20):
        names = Random(seed)
        old, new = ([side + "".join(names.choice("abcd") for _ in range(7)) for _ in range(9)] for side in "xy")
        pair = lambda i, j: 1 + 0.05 * (i != j) + 0.1 * (1 - _likeness(old[i], new[j]))  # noqa: E731, B023

        @lru_cache(None)
        def best(i, used):
            return min((pair(i, j) + best(i + 1, used | 1 << j) for j in range(9) if not used >> j & 1), default=0.0)  # noqa: B023

        cost, changes = edit_script(tree([(n, "decimal") for n in old]), tree([(n, "decimal") for n in new]))
        assert len(changes) == 9 and abs(cost - best(0, 0)) < 1e-9


def files(spark, sets, extra=""):
    f, lines, n = [], [], 0
    for i, (day, rows) in enumerate(sets):
        f.append((i, 1, day, "clash"))
        for k, row in enumerate(rows):
            lines.append((n, i, k + 1, row, "clash"))
            n += 1
    return spark.createDataFrame(f, "file_id long, stream_id long, file_day string, header string"), spark.createDataFrame(lines, "line_id long, file_id long, line_no int, line string, sep string")


def test_changes_and_table(spark):
    f, lines = files(
        spark,
        [
            ("2025-01-03", ["7;20250103 100000000;1.5", "8;20250103 100001000;1.6"]),  # no header: the day before's columns
            ("2025-01-01", ["dt,bid,vol", "20250101 100000000,1.5,1", "20250101 100001000,,2", "dt,bid,vol"]),
            ("2025-01-02", [" VOL \tDT\tBid_px", "5\t20250102 100000000\t1.5", "5\t20250102 100000000\t1.5", None]),
            ("2025-01-04", ["dt,bid_px,vol,venue", "1735984800000,1.5,2.5,X"]),
        ],
    )
    got = {(r.file_id, r.change_kind, r.field_name) for r in drift_changes(f, lines).collect()}
    assert got == {(2, "renamed", "bid_px"), (3, "retyped", "dt"), (3, "retyped", "vol"), (3, "added", "venue")}
    table = drift_table(f, lines)
    assert dict(table.dtypes) == {"line_id": "bigint", "file_id": "bigint", "stream_id": "bigint", "line_no": "int", "bid": "double", "dt": "string", "venue": "string", "vol": "double", "extra": "map<int,string>"}
    rows = {r.line_id: (r.dt, r.bid, r.vol, r.venue, r.extra) for r in table.collect()}
    assert rows[3] == ("20250101 100000000", 1.5, 1.0, None, {}) and rows[4] == ("20250101 100001000", None, 2.0, None, {})
    assert rows[0] == ("20250103 100000000", 1.5, 7.0, None, {}) and rows[11] == ("1735984800000", 1.5, 2.5, "X", {})


def test_one_table_of_several_streams(spark):
    """Whatever the columns are called and wherever they stand, every cell lands in its lineage's column."""
    rng = Random(5)
    f, lines, want, n = [], [], {}, 0
    for stream in range(6):
        names, order = ["dt", "bid", "file_id"], [0, 1, 2]
        for day in range(5):
            file = stream * 10 + day
            f.append((file, stream, f"2025-01-{day + 1:02d}"))
            if day == 2:
                names = ["dt", "bid_px", "file_id"]
            rng.shuffle(order)
            lines.append((n, file, 1, ";".join(names[i] for i in order)))
            n += 1
            for k in range(3):
                values = [f"2025-01-{day + 1:02d} 10:00:0{k}", f"{rng.random() + 1:.3f}" if rng.random() < 0.8 else "", str(rng.randrange(100))]
                lines.append((n, file, k + 2, ";".join(values[i] for i in order) + (";more" if k == 1 else "")))
                want[n] = (values[0], float(values[1]) if values[1] else None, int(values[2]), {4: "more"} if k == 1 else {})
                n += 1
    f, lines = spark.createDataFrame(f, "file_id long, stream_id long, file_day string"), spark.createDataFrame(lines, "line_id long, file_id long, line_no int, line string")
    table = drift_table(f, lines)
    assert table.columns == ["line_id", "file_id", "stream_id", "line_no", "bid", "dt", "file_id_value", "extra"]
    assert {r.line_id: (r.dt, r.bid, r.file_id_value, r.extra) for r in table.collect()} == want


def test_empty(spark):
    f, lines = files(spark, [("2025-01-01", ["a,b", "1,2"])])
    assert drift_changes(f.limit(0), lines).count() == 0
    assert drift_changes(f, lines.limit(0)).count() == 0
    assert drift_changes(f, lines).count() == 0 and drift_table(f, lines).count() == 1
    nulls = f.selectExpr("file_id", "cast(null as long) stream_id", "file_day")
    assert drift_changes(nulls, lines).count() == 0

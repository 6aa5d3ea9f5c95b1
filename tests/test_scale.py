import pytest

from tidebar.scale import lookup_join


@pytest.mark.parametrize("limit", [1, 100])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookups_of_any_size(spark, limit, how):
    big = spark.createDataFrame([(i, "a" if i % 2 else None, "x" if i % 3 else None) for i in range(30)], "i int, k string, l string")
    small = spark.createDataFrame([("a", None, 1), (None, "x", 2), (None, None, 3)], "k string, l string, v int")
    want = {(r.i, {("a", None): 1, (None, "x"): 2, (None, None): 3}.get((r.k, r.l))) for r in big.collect()}
    got = lookup_join(big, small, ["k", "l"], how, limit, null_safe=True)
    assert got.columns == ["i", "k", "l", "v"]
    assert {(r.i, r.v) for r in got.collect()} == {x for x in want if how == "left" or x[1]}
    plain = lookup_join(big, small.where("k = 'a'").drop("l"), ["k"], how, limit)
    assert {(r.i, r.v) for r in plain.collect()} == {(r.i, 1 if r.k else None) for r in big.collect() if r.k or how == "left"}

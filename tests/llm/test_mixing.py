import os
import random

import pytest
from pyspark.sql import functions as F

from tidebar.llm import mixing as M

pytestmark = pytest.mark.skipif(not os.path.exists(M.TOKENIZER), reason="no tokenizer file here")


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    rows = [(i, s, " ".join(rng.choice(["bar", "tick", "volatility", "close"]) for _ in range(rng.randint(1, 60)))) for i, s in enumerate(["a"] * 3000 + ["b"] * 400 + ["c"] * 900 + ["x"] * 50)]
    rows += [(9001, "a", None), (9002, "b", "   "), (9003, None, "text"), (9004, "b", "")]
    docs = spark.createDataFrame([(*r, 1.0, 5) for r in rows], "doc_id long, source string, text string, rate double, copies int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 2), ("none", 0.0, 3)], "source string, target_share double, max_repeats int")
    return docs, targets


def slow(counted, rates, seed):
    """Copies by one running sum per source."""
    import math

    out = {}
    offset = 0.001 + 0.998 * ((seed * 2654435761) % 2**32) / 2**32
    for s, rows in counted.items():
        for k, i in enumerate(rows):
            out[i] = math.floor(rates.get(s, 0.0) * (k + 1) + offset) - math.floor(rates.get(s, 0.0) * k + offset)
    return out


@pytest.mark.parametrize("bucket", [20_000, 100])
def test_shares_and_copies(spark, tables, monkeypatch, bucket):
    monkeypatch.setattr(M, "BUCKET", bucket)
    docs, targets = tables
    drawn, plan = M.plan_mix(docs, targets)
    rows = {r.source: r for r in M.shares(drawn, plan).collect()}
    assert drawn.count() == docs.count()
    for s in "abc":
        assert abs(rows[s].actual_share - rows[s].target_share) < 0.02
        assert rows[s].most_copies <= rows[s].max_repeats
        assert rows[s].drawn_copies in (int(rows[s].rate * rows[s].docs), int(rows[s].rate * rows[s].docs) + 1)
    assert rows["x"].drawn_copies == rows[None].drawn_copies == 0 and rows["none"].docs == 0
    assert max(rows[s].rate / rows[s].max_repeats for s in "abc") == pytest.approx(1)
    copies = {r.doc_id: r.copies for r in drawn.collect()}
    assert copies[9001] == copies[9002] == copies[9003] == copies[9004] == 0
    n = docs.count() // bucket + 1
    order = docs.where(F.trim("text") != "").where("source is not null").withColumn("h", F.xxhash64(F.lit(7), F.col("doc_id").cast("long"))).withColumn("b", F.shiftrightunsigned("h", 1) % n)
    by = {}
    for r in order.orderBy("source", "b", "h").collect():
        by.setdefault(r.source, []).append(r.doc_id)
    want = slow(by, {s: rows[s].rate for s in "abc"}, 7)
    assert {i: c for i, c in copies.items() if i in want} == want


def test_given_total_caps_small_sources(spark, tables):
    docs, targets = tables
    rows = {r.source: r for r in M.mix(docs, targets, total_tokens=10**9)[1].collect()}
    assert all(rows[s].most_copies == rows[s].max_repeats == rows[s].rate for s in "abc")


def test_empty(spark, tables):
    docs, targets = tables
    mixed, report = M.mix(docs.limit(0), targets)
    assert mixed.count() == 0 and report.agg(F.sum("drawn_tokens")).first()[0] == 0
    mixed, report = M.mix(docs, targets.limit(0))
    assert mixed.count() == 0 and report.count() == 5


def test_copies_come_with_their_text(spark, tables):
    docs, targets = tables
    docs = docs.unionByName(docs.where("doc_id < 40"))  # rows that are there twice
    drawn, _ = M.plan_mix(docs, targets)
    mixed = M.mix(docs, targets)[0]
    want = {(r.doc_id, r.source): (r.n, r.t) for r in drawn.groupBy("doc_id", "source").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("tokens")).alias("t")).collect() if r.n}
    assert {(r.doc_id, r.source): (r.n, r.t) for r in mixed.groupBy("doc_id", "source").agg(F.count("*").alias("n"), F.sum("tokens").alias("t")).collect()} == want
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(texts[r.doc_id] == r.text for r in mixed.collect())
    assert {r.copy_no for r in mixed.where("source = 'b'").collect()} <= {1, 2, 3, 4}

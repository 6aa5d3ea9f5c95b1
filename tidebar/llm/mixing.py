"""Mixing sources to target shares of the tokens (problem 8), by systematic sampling.

Only ids, sizes and hashes of the texts are sorted and summed; the texts join the drawn rows at the end.
"""

from __future__ import annotations

import os
import pickle
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import bucket_offsets, lookup_join, ranked
from ..session import materialize, share

#: A byte-level BPE file for the ``tokenizers`` library; pass another path where it lies elsewhere.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Documents of one bucket of the prefix sum, aimed at.
BUCKET = 20_000


def _token_counter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_buffer(pickle.loads(shared.value))
        tokenizer.encode_special_tokens = True
        for batch in batches:
            counts = []
            for a in range(0, batch.num_rows, 256):
                texts = [t or "" for t in batch["text"].slice(a, 256).to_pylist()]
                counts += [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["source"], batch["text_key"], pa.array(counts, pa.int64())], names=["doc_id", "source", "text_key", "tokens"])

    return run


def count_tokens(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, text_key, tokens`` of every document's whole text; a null or blank text has none.

    The driver reads the tokenizer's file and sends it along, so workers need not have it.
    """
    with open(tokenizer, "rb") as f:
        shared = share(documents.sparkSession, f.read())
    return _plain(documents).mapInArrow(_token_counter(shared), "doc_id long, source string, text_key long, tokens long")


def _plain(documents: DataFrame) -> DataFrame:
    """``doc_id, source, text, text_key``; blank texts are null."""
    text = F.col("text").cast("string")
    x = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.when(F.trim(text) != "", text).alias("text"))
    return x.withColumn("text_key", F.xxhash64("text"))


def plan_shares(counted: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """Expected copies of each source's documents: ``source, target_share, max_repeats, docs, tokens, rate``.

    Without ``total_tokens`` the mix is the largest in which every listed source that has tokens reaches its share within
    its repeats; with it, a source that cannot fill its share is used ``max_repeats`` times and stays below. Sources
    that are not listed, and listed ones without tokens, have rate 0. Repeated targets of a source add up.
    """
    wanted = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = counted.groupBy("source").agg(F.sum((F.col("tokens") > 0).cast("long")).alias("docs"), F.sum("tokens").alias("tokens"))
    x = have.join(wanted, "source", "full").select("source", F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"), F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    x = materialize(x, "shares")
    if total_tokens is None:
        usable = F.when((F.col("target_share") > 0) & (F.col("tokens") > 0), F.col("max_repeats") * F.col("tokens") / F.col("target_share"))
        total_tokens = x.agg(F.min(usable)).first()[0] or 0.0
    rate = F.when((F.col("target_share") > 0) & (F.col("tokens") > 0), F.least(F.col("target_share") * F.lit(float(total_tokens)) / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return x.withColumn("rate", rate)


def draw(counted: DataFrame, plan: DataFrame, seed: int = 7) -> DataFrame:
    """``doc_id, source, text_key, tokens, copies``: systematic sampling along a seeded order of each source's documents.

    A document's expected copies are added up within its source, one offset in (0, 1) is added, and the document is
    emitted once for each integer its stretch crosses, so it gets the floor or the ceiling of its rate. Documents
    without tokens are never drawn and take no place in the sum. The sum runs over hashed buckets whose totals are
    added up first, so a source may be of any size. Every input row comes out, with 0 copies if it isn't drawn.
    """
    rows = counted.count()
    buckets = max(1, rows // BUCKET + 1)
    h = F.xxhash64(F.lit(seed), F.col("doc_id"))
    live = counted.where("tokens > 0 and source is not null").withColumns({"_h": h, "_b": F.shiftrightunsigned(h, 1) % buckets})
    small = materialize(plan.select("source", "rate", "max_repeats"), "rates")
    placed = ranked(live, ["source"], "_b", ["_h", "doc_id"], bucket_offsets(live, ["source"], "_b"))
    placed = lookup_join(placed, small, ["source"])
    # the offset is kept off the ends, where rounding could add a crossing
    offset = 0.001 + 0.998 * ((seed * 2654435761) % 2**32) / 2**32
    at = lambda r: F.floor(F.coalesce("rate", F.lit(0.0)) * r + offset)
    copies = F.least(at(F.col("_rank") + 1) - at(F.col("_rank")), F.coalesce("max_repeats", F.lit(0)).cast("long"))
    drawn = placed.select("doc_id", "source", "text_key", "tokens", copies.cast("int").alias("copies"))
    none = counted.where("tokens <= 0 or source is null").select("doc_id", "source", "text_key", "tokens", F.lit(0).alias("copies"))
    return drawn.unionByName(none)


def emit(documents: DataFrame, drawn: DataFrame) -> DataFrame:
    """``doc_id, source, copy_no, tokens, text``: one row for each copy drawn, ``copy_no`` from 1.

    Rows that agree in id, source and text are told apart by a number, so repeated rows keep the copies each was drawn for.
    """
    keys = ["doc_id", "source", "text_key"]
    w = Window.partitionBy(*keys).orderBy(*keys)
    wanted = drawn.withColumn("_n", F.row_number().over(w)).where("copies > 0")
    texts = _plain(documents).where("text is not null and source is not null").withColumn("_n", F.row_number().over(w))
    same = reduce(Column.__and__, [F.col(f"t.{k}").eqNullSafe(F.col(f"d.{k}")) for k in [*keys, "_n"]])
    joined = texts.alias("t").join(wanted.alias("d"), same)
    return joined.select("t.doc_id", "t.source", F.explode(F.sequence(F.lit(1), F.col("d.copies"))).alias("copy_no"), "d.tokens", "t.text")


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, total_tokens: float | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(the training mix: a row ``doc_id, source, copy_no, tokens, text`` for each copy; report of the shares reached).

    ``documents``: ``doc_id, source, text``; ``targets``: ``source, target_share, max_repeats``; other columns are
    ignored. The report has ``source, target_share, max_repeats, docs, tokens, rate, drawn_copies, most_copies,
    drawn_tokens, actual_share`` for every source of either table. Empty tables give empty results.
    """
    drawn, plan = plan_mix(documents, targets, tokenizer, total_tokens, seed)
    return emit(documents, drawn), shares(drawn, plan)


def plan_mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, total_tokens: float | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(copies of every document, as ``draw`` gives them; rates of the sources)."""
    counted = materialize(count_tokens(documents, tokenizer), "tokens")
    plan = materialize(plan_shares(counted, targets, total_tokens), "plan")
    return materialize(draw(counted, plan, seed), "drawn"), plan


def shares(drawn: DataFrame, plan: DataFrame) -> DataFrame:
    """What each source contributes, and its share of all drawn tokens."""
    got = drawn.groupBy("source").agg(F.sum("copies").alias("drawn_copies"), F.max("copies").alias("most_copies"), F.sum(F.col("copies") * F.col("tokens")).alias("drawn_tokens"))
    whole = got.agg(F.sum("drawn_tokens").alias("all_tokens"))
    report = plan.join(got, plan["source"].eqNullSafe(got["source"]), "left").drop(got["source"]).crossJoin(F.broadcast(whole))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    report = report.select("source", "target_share", "max_repeats", "docs", "tokens", "rate", zero("drawn_copies"), zero("most_copies"), zero("drawn_tokens"), F.coalesce(F.expr("try_divide(drawn_tokens, all_tokens)"), F.lit(0.0)).alias("actual_share"))
    return report

"""Helpers that keep hot keys and growing lookups from ending up in one task or in every executor."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A lookup is broadcast only up to this many rows (about 10 MB for the narrow lookups used here).
BROADCAST_ROWS = 200_000


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", limit: int = BROADCAST_ROWS, null_safe: bool = False) -> DataFrame:
    """Equi-join of a large, possibly skewed table with a lookup that is unique on ``on``.

    The lookup's rows are counted first (it should be cheap to read, e.g. materialized). Up to ``limit`` rows it is
    broadcast, beyond that both sides are shuffled on the keys, and adaptive execution splits the partitions of hot keys.
    With ``null_safe`` null keys meet null keys.
    """
    side = F.broadcast(small) if small.limit(limit + 1).count() <= limit else small
    if not null_safe:
        return big.join(side, on, how)
    side = side.withColumnsRenamed({k: f"_on_{k}" for k in on})
    meets = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in on], F.lit(True))
    return big.join(side, meets, how).drop(*[f"_on_{k}" for k in on])


def bucket_offsets(df: DataFrame, keys: list[str], bucket: str, weight: Column | None = None) -> DataFrame:
    """Sum of ``weight`` (rows, if none) in all earlier buckets of the same key: ``keys, bucket, _before, _total``.

    Only one row per key and bucket reaches the window.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(weight if weight is not None else F.lit(1)).alias("_w"))
    w = Window.partitionBy(*keys).orderBy(bucket)
    return sums.select(
        *keys,
        bucket,
        (F.sum("_w").over(w) - F.col("_w")).alias("_before"),
        F.sum("_w").over(Window.partitionBy(*keys)).alias("_total"),
    )


def ranked(df: DataFrame, keys: list[str], bucket: str, order: list[str], start: DataFrame | None = None) -> DataFrame:
    """Rank of each row within its key (0-based, ``_rank``) where ``bucket`` is non-decreasing in ``order``.

    Rows are numbered inside (key, bucket) and the buckets' sizes are added up, so no task sorts a whole hot key.
    """
    start = bucket_offsets(df, keys, bucket) if start is None else start
    inner = Window.partitionBy(*keys, bucket).orderBy(*order)
    numbered = df.withColumn("_in", F.row_number().over(inner) - 1)
    return (
        numbered.join(start.select(*keys, bucket, "_before"), [*keys, bucket])
        .withColumn("_rank", F.col("_before") + F.col("_in"))
        .drop("_in", "_before")
    )


def blocked(df: DataFrame, keys: list[str], index: str, size: int, before: int = 0, after: int = 0) -> DataFrame:
    """Cut each key into blocks of ``size`` consecutive rows with copies of the rows around them.

    Adds ``_block`` and ``_core`` (false for copies). A frame that reaches at most ``before`` rows back and ``after``
    rows ahead gives the same result within a block as within the whole key, so windows and grouped functions run on
    (key, block) and no task holds a whole hot key. ``index`` is the row's 0-based number in its key.
    """
    home = F.floor(F.col(index) / size)
    first = F.floor((F.col(index) - after) / size)
    last = F.floor((F.col(index) + before) / size)
    spread = df.withColumns({"_home": home, "_block": F.explode(F.sequence(F.greatest(first, F.lit(0)), last))})
    return spread.withColumn("_core", F.col("_home") == F.col("_block")).drop("_home")


def last_known(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """Add ``name``: the last non-null ``value`` up to and including the row, per key.

    ``bucket`` must be non-decreasing in ``order`` (a day, a block number). Rows are scanned within their bucket, and
    only one row per bucket takes part in the scan over buckets.
    """
    w = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = df.where(F.col(value).isNotNull()).groupBy(*keys, bucket).agg(F.max_by(value, F.struct(*order)).alias("_end"))
    buckets = df.select(*keys, bucket).distinct().join(ends, [*keys, bucket], "left")
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select(*keys, bucket, F.last("_end", True).over(before).alias("_carry"))
    x = df.withColumn(name, F.last(value, True).over(w)).join(carried, [*keys, bucket])
    return x.withColumn(name, F.coalesce(name, "_carry")).drop("_carry")


def by_group(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle to as many tasks as the session has shuffle partitions, before a function in Python on each group.

    Adaptive execution would merge partitions by their bytes, but what these functions cost is their time per row.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def scan_groups(df: DataFrame, keys: list[str], order: str, start: Callable, step: Callable, schema: str) -> DataFrame:
    """Ordered scan of each key: ``step(state, table) -> table`` on consecutive pieces, ``start(table)`` makes the state.

    Each task goes through its sorted rows batch by batch and keeps only the state, so a key of any length fits in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            change = np.zeros(batch.num_rows, bool)
            for k in keys:
                column = table[k].combine_chunks()
                same = pc.fill_null(pc.equal(column[1:], column[:-1]), False)
                nulls = pc.and_(pc.is_null(column[1:]), pc.is_null(column[:-1]))
                change[1:] |= ~pc.or_(same, nulls).to_numpy(zero_copy_only=False)
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                piece = table.slice(a, b - a)
                key = tuple(piece[k][0].as_py() for k in keys)
                if key != current:
                    state, current = start(piece), key
                yield from step(state, piece).combine_chunks().to_batches()

    return by_group(df, *keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)

"""Percentiles of very large columns per group by distributed multi-select (problem 5).

Values lie in sorted chunks of bounded size. Every chunk proposes the median of its candidates, the weighted median of
the proposals becomes the pivot, one pass counts below, equal and above, ruled-out ranges are dropped, and this repeats
for all groups and percentiles at once until each is found. The answers are exact for the values given.

Days (or partitions) can be kept as summaries of bounded rank error: every ``step``-th value with its weight. Summaries
of separate days are simply put together, and the same select on weighted values answers for the whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import lookup_join
from ..session import drop_table, materialize

#: Values of a chunk, aimed at; chunks of one proposal group; candidates that are brought together and picked from at the end.
CHUNK, FAN, FEW = 4096, 256, 1024
#: Every round rules out at least a quarter of a target's candidates, so this many are never needed.
MOST_ROUNDS = 400

_STATS = ["t", "lt", "eq", "med_b", "n_b", "c_b", "med_a", "n_a", "c_a"]


def _chunks(df: DataFrame, keys: list[str], value: str, weight: str | None, spread: str) -> tuple[DataFrame, DataFrame]:
    """(groups ``keys, gid, total, chunks``; sorted chunks ``gid, chunk, chunks, total, vals`` of the finite values).

    Groups are numbered in a written table and met by their keys, nulls as a value of their own, so no two share a
    number. Weighted chunks have the weights ``w`` beside ``vals``.
    """
    v = F.col(value).cast("double")
    extra = [F.col(weight).cast("double").alias("_w")] if weight else []
    x = df.select(*keys, v.alias("_v"), *extra, F.xxhash64(F.col(spread)).alias("_h")).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    # -0.0 and 0.0 are one value
    x = x.withColumn("_v", F.col("_v") + 0.0)
    sizes = x.groupBy(*keys).agg(F.count("*").alias("_n"), (F.sum("_w") if weight else F.count("*").cast("double")).alias("total"))
    groups = materialize(sizes.where("_n > 0").select(*keys, F.monotonically_increasing_id().alias("gid"), "total", F.ceil(F.col("_n") / CHUNK).alias("chunks")), "groups")
    x = lookup_join(x, groups, keys, "inner", null_safe=True)
    x = x.withColumn("chunk", F.pmod(F.xxhash64("_h", "_v"), F.col("chunks")))
    by = ["gid", "chunk", "chunks", "total"]
    if not weight:
        return groups, x.groupBy(*by).agg(F.array_sort(F.collect_list("_v")).alias("vals"))
    packed = x.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_v", "_w"))).alias("_a"))
    return groups, packed.select(*by, F.transform("_a", lambda s: s["_v"]).alias("vals"), F.transform("_a", lambda s: s["_w"]).alias("w"))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    at = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(at, pa.array(np.concatenate(parts) if parts else np.zeros(0)))


def _round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each chunk, and its counts and next proposals for each open target of its group.

    A value stays while it lies in the open range of any target. Counts and medians of a target are those inside its range.
    """
    for batch in batches:
        vo, vv = np.asarray(batch["vals"].offsets), batch["vals"].values.to_numpy(zero_copy_only=False)
        weighted = "w" in batch.schema.names
        wv = batch["w"].values.to_numpy(zero_copy_only=False) if weighted else None
        to, targets = np.asarray(batch["targets"].offsets), batch["targets"].values
        t_id, lo, hi, pivot = (targets.field(c).to_numpy(zero_copy_only=False) for c in ("t", "lo", "hi", "pivot"))
        kept, kept_w, size = [], [], []
        out: dict[str, list] = {c: [] for c in _STATS}
        for i in range(batch.num_rows):
            v = vv[vo[i] : vo[i + 1]]
            mine = slice(to[i], to[i + 1])
            cum = np.concatenate([[0.0], np.cumsum(wv[vo[i] : vo[i + 1]])]) if weighted else np.arange(len(v) + 1, dtype=float)
            a, b = np.searchsorted(v, lo[mine], "right"), np.searchsorted(v, hi[mine], "left")
            b = np.maximum(a, b)
            p, q = np.clip(np.searchsorted(v, pivot[mine], "left"), a, b), np.clip(np.searchsorted(v, pivot[mine], "right"), a, b)
            cover = np.zeros(len(v) + 1, np.int64)
            np.add.at(cover, a, 1)
            np.add.at(cover, b, -1)
            open_ = np.cumsum(cover[:-1]) > 0
            kept.append(v[open_])
            if weighted:
                kept_w.append(wv[vo[i] : vo[i + 1]][open_])
            size.append(to[i + 1] - to[i])
            out["t"].append(t_id[mine])
            out["lt"].append(cum[p] - cum[a])
            out["eq"].append(cum[q] - cum[p])
            for name, x, y in (("b", a, p), ("a", q, b)):
                n = cum[y] - cum[x]
                middle = np.clip(np.searchsorted(cum, cum[x] + n / 2, "right") - 1, x, np.maximum(x, y - 1))
                out[f"med_{name}"].append(np.where(y > x, v[np.minimum(middle, max(len(v) - 1, 0))] if len(v) else 0.0, 0.0))
                out[f"n_{name}"].append(n)
                out[f"c_{name}"].append((y - x).astype(float))
        fields = [pa.array(np.concatenate(out[c]), pa.int32() if c == "t" else pa.float64()) for c in _STATS]
        stats = pa.ListArray.from_arrays(np.cumsum([0, *size]).astype(np.int32), pa.StructArray.from_arrays(fields, _STATS))
        columns = {"gid": batch["gid"], "chunk": batch["chunk"], "vals": _lists(kept)} | ({"w": _lists(kept_w)} if weighted else {}) | {"stats": stats}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _place(p: float | tuple[float, str], n):
    """Rank asked for among n values: the share p's, or for (p, "low" / "high") those around (n - 1) * p."""
    if isinstance(p, tuple):
        at = (n - 1) * p[0]
        return (F.floor(at + 1e-9) if p[1] == "low" else F.ceil(at - 1e-9)) + 1 if isinstance(n, Column) else (math.floor(at + 1e-9) if p[1] == "low" else math.ceil(at - 1e-9)) + 1
    if isinstance(n, Column):
        return F.greatest(F.ceil(F.lit(p) * n - 1e-9), F.lit(1))
    return max(math.ceil(p * n - 1e-9), 1)


def _answer(probs: list):
    """Direct selection in chunks that hold their whole group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, v = np.asarray(batch["vals"].offsets), batch["vals"].values.to_numpy(zero_copy_only=False)
            w = batch["w"].values.to_numpy(zero_copy_only=False) if "w" in batch.schema.names else np.ones(len(v))
            total = batch["total"].to_numpy(zero_copy_only=False)
            out = np.full((len(probs), batch.num_rows), np.nan)
            for i in range(batch.num_rows):
                cum = np.cumsum(w[at[i] : at[i + 1]])
                for j, p in enumerate(probs):
                    out[j, i] = v[at[i] + min(np.searchsorted(cum, _place(p, float(total[i])) - 1e-9), len(cum) - 1)]
            yield pa.RecordBatch.from_arrays([batch["gid"], *map(pa.array, out)], names=["gid", *[f"q{j}" for j in range(len(probs))]])

    return run


def _weighted_median(pairs: Column) -> Column:
    """Median of an array of (m, n) structs weighted by n; null without proposals."""
    live = F.array_sort(F.filter(pairs, lambda s: s["m"].isNotNull() & (s["n"] > 0)))
    half = F.aggregate(live, F.lit(0.0), lambda a, s: a + s["n"]) / 2
    start = F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("double").alias("m"))
    step = lambda a, s: F.when((a["c"] < half) | a["m"].isNull(), F.struct((a["c"] + s["n"]).alias("c"), s["m"].alias("m"))).otherwise(a)
    return F.aggregate(live, start, step)["m"]


def _gather(df: DataFrame, by: list[str], sides: tuple[str, ...], sums: tuple[str, ...]) -> DataFrame:
    """Proposals of chunks brought together in steps of at most FAN, so no list grows with the group."""

    def level(x: DataFrame, keys: list[str]) -> DataFrame:
        aggs = [F.sum(c).alias(c) for c in sums]
        aggs += [F.collect_list(F.struct(F.col(f"med_{s}").alias("m"), F.col(f"n_{s}").alias("n"))).alias(f"_l{s}") for s in sides]
        aggs += [F.sum(f"n_{s}").alias(f"n_{s}") for s in sides]
        out = x.groupBy(*keys).agg(*aggs)
        return out.withColumns({f"med_{s}": _weighted_median(F.col(f"_l{s}")) for s in sides}).drop(*[f"_l{s}" for s in sides])

    x = df
    for size in (FAN, FAN * FAN):
        x = level(x.withColumn("_part", F.floor(F.col("chunk") / size)), [*by, "_part"]).withColumn("chunk", F.col("_part") * size)
    return level(x, by)


def multi_select(df: DataFrame, keys: list[str], value: str, probs: list, spread: str, weight: str | None = None) -> DataFrame:
    """``keys, n`` and ``q0, q1, ...``: for each prob p the smallest value with at least the share p of the group at or below it.

    ``n`` is the number (or weight) of finite values; nulls, NaN and infinities are left out, and a group without finite
    values has no row. Null keys form groups of their own. ``spread`` is a column that tells rows apart (an id); rows
    that repeat count each time. An empty table gives an empty result. A prob may be ``(p, "low")`` or ``(p, "high")`` for
    the values around the place (n - 1) * p.
    """
    groups, chunks = _chunks(df, keys, value, weight, spread)
    chunks = materialize(chunks, "chunks")
    held = ["vals", "w"] if weight else ["vals"]
    # a group that one chunk holds is answered by that chunk; there is nothing to bring together
    single = chunks.where("chunks = 1").select("gid", "total", *held).mapInArrow(_answer(probs), "gid long" + "".join(f", q{i} double" for i in range(len(probs))))
    many = chunks.where("chunks > 1")
    answers = single if many.isEmpty() else single.unionByName(_select(many, groups.where("chunks > 1"), probs, held))
    return groups.join(answers, "gid").select(*keys, F.col("total").alias("n"), *[f"q{i}" for i in range(len(probs))])


def _select(many: DataFrame, groups: DataFrame, probs: list, held: list[str]) -> DataFrame:
    """``gid, q0, ...`` of groups in several chunks: rounds of pivots, counts and ruling out until each target is found.

    A target's state is the rank it looks for inside its open range (lo, hi). A round reads what the last one left of
    the chunks and writes what is still inside some range.
    """
    first = _gather(many.select("gid", "chunk", F.get("vals", (F.size("vals") / 2).cast("int")).alias("med_a"), F.size("vals").cast("double").alias("n_a")), ["gid"], ("a",), ())
    wanted = F.array(*[F.struct(F.lit(i).alias("t"), F.least(_place(p, F.col("total")).cast("double"), F.col("total")).alias("k")) for i, p in enumerate(probs)])
    inf = F.lit(float("inf"))
    state = groups.select("gid", F.explode(wanted).alias("_t")).join(first.select("gid", F.col("med_a").alias("pivot")), "gid")
    state = materialize(state.select("gid", "_t.*", (-inf).alias("lo"), inf.alias("hi"), "pivot"), "state")
    list_type = "array<double>"
    schema = f"gid long, chunk long, {', '.join(f'{c} {list_type}' for c in held)}, stats array<struct<t:int,{','.join(f'{c}:double' for c in _STATS[1:])}>>"
    data, last, done = many.select("gid", "chunk", *held), None, []
    for _ in range(MOST_ROUNDS):
        targets = materialize(state.groupBy("gid").agg(F.collect_list(F.struct("t", "lo", "hi", "pivot")).alias("targets")), "targets")
        told = materialize(lookup_join(data, targets, ["gid"], "inner").mapInArrow(_round, schema), "round")
        drop_table(last)
        last, data = told, told.where(F.size("vals") > 0).select("gid", "chunk", *held)
        stats = told.select("gid", "chunk", F.explode("stats").alias("s")).select("gid", "chunk", "s.*")
        totals = _gather(stats, ["gid", "t"], ("b", "a"), ("lt", "eq", "c_b", "c_a"))
        k, lt, le = F.col("k"), F.col("lt"), F.col("lt") + F.col("eq")
        below, hit = k <= lt + 1e-9, k <= le + 1e-9
        state = state.join(totals, ["gid", "t"]).select(
            "gid", "t",
            F.when(below, k).otherwise(k - le).alias("k"),
            F.when(below, F.col("lo")).otherwise(F.col("pivot")).alias("lo"),
            F.when(below, F.col("pivot")).otherwise(F.col("hi")).alias("hi"),
            F.when(below, F.col("med_b")).when(hit, F.col("pivot")).otherwise(F.col("med_a")).alias("pivot"),
            F.when(~below & hit, F.col("pivot")).alias("answer"),
            F.when(below, F.col("c_b")).otherwise(F.col("c_a")).alias("left"),
        )
        state = materialize(state, "state")
        done.append(state.where("answer is not null").select("gid", "t", "answer"))
        state = state.where("answer is null")
        # the last candidates of a target are brought together and picked from
        few = state.where(F.col("left") <= FEW)
        rest, ready = state.agg(F.count(F.when(F.col("left") > FEW, 1)), F.count(F.when(F.col("left") <= FEW, 1))).first()
        if ready:
            done.append(materialize(_pick(data, few, held), "picked"))
        if not rest:
            drop_table(last)
            found = reduce(DataFrame.unionByName, done)
            return found.groupBy("gid").agg(*[F.max(F.when(F.col("t") == i, F.col("answer"))).alias(f"q{i}") for i in range(len(probs))])
        state = state.where(F.col("left") > FEW)
    raise RuntimeError(f"multi-select left targets open after {MOST_ROUNDS} rounds")


def _pick(data: DataFrame, few: DataFrame, held: list[str]) -> DataFrame:
    """Answers of targets with at most FEW candidates left: the first at which the weight inside the range reaches k."""
    asked = materialize(few.groupBy("gid").agg(F.collect_list(F.struct("t", "k", "lo", "hi")).alias("targets")), "few")
    x = lookup_join(data, asked, ["gid"], "inner").select("gid", *held, F.explode("targets").alias("s")).select("gid", "s.*", *held)
    lo, hi = F.col("lo"), F.col("hi")
    if "w" in held:
        inside = F.filter(F.zip_with("vals", "w", lambda v, w: F.struct(v.alias("v"), w.alias("w"))), lambda s: (s["v"] > lo) & (s["v"] < hi))
    else:
        inside = F.filter("vals", lambda v: (v > lo) & (v < hi))
    parts = x.select("gid", "t", "k", inside.alias("mid")).where(F.size("mid") > 0)
    whole = parts.groupBy("gid", "t", "k").agg(F.array_sort(F.flatten(F.collect_list("mid"))).alias("mid"))
    if "w" not in held:
        return whole.select("gid", "t", F.get("mid", F.col("k").cast("int") - 1).alias("answer"))
    start = F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("double").alias("v"))
    step = lambda a, s: F.when(a["c"] < F.col("k") - 1e-9, F.struct((a["c"] + s["w"]).alias("c"), s["v"].alias("v"))).otherwise(a)
    return whole.select("gid", "t", F.aggregate("mid", start, step)["v"].alias("answer"))


def day_summaries(df: DataFrame, keys: list[str], day: str, value: str, spread: str, error: float = 0.005) -> DataFrame:
    """Mergeable summaries ``keys, day, value, weight``: the rank of any value is off by at most ``error`` times the day's count.

    Each sorted chunk of a day keeps the middle of every run of ``step`` values with the run's length as its weight;
    ``step`` is at most ``2 * error`` of the chunk, so errors of chunks and days add up to no more than the same share.
    """
    groups, chunks = _chunks(df, [*keys, day], value, None, spread)
    n = F.size("vals")
    step = F.greatest(F.lit(1), F.floor(n * (2 * error)).cast("int"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int")), lambda i: F.struct(F.get("vals", F.least(i * step + F.floor((F.least(step, n - i * step) - 1) / 2).cast("int"), n - 1)).alias("value"), F.least(step, n - i * step).cast("double").alias("weight")))
    kept = chunks.select("gid", F.explode(runs).alias("s")).select("gid", "s.value", "s.weight")
    return lookup_join(kept, groups.select("gid", *keys, day), ["gid"], "inner").select(*keys, day, "value", "weight")


def combine_summaries(summaries: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """Percentiles of the whole from the summaries of any days, with their common rank error."""
    merged = summaries.groupBy(*keys, "value").agg(F.sum("weight").alias("weight"))
    return multi_select(merged, keys, "value", probs, "value", "weight")


def rank_error(n: int, error: float = 0.005) -> int:
    """Largest rank error of ``combine_summaries`` over n values."""
    return math.ceil(error * n)


def interpolated(df: DataFrame, keys: list[str], value: str, probs: list[float], spread: str) -> DataFrame:
    """``keys, n, q0, ...``: percentiles with linear interpolation between the two values around (n - 1) * p, exact."""
    ends = multi_select(df, keys, value, [(p, side) for p in probs for side in ("low", "high")], spread)

    def between(i: int, p: float) -> Column:
        at = (F.col("n") - 1) * p
        lo, hi = F.col(f"q{2 * i}"), F.col(f"q{2 * i + 1}")
        return lo + (hi - lo) * (at - F.floor(at + 1e-9))

    return ends.select(*keys, F.col("n").cast("long").alias("n"), *[between(i, p).alias(f"p{i}") for i, p in enumerate(probs)]).withColumnsRenamed({f"p{i}": f"q{i}" for i in range(len(probs))})

"""Implausible bars: impossible, frozen or jumping prices, judged against each series' own behaviour (problem 4).

A hidden Markov model with the states normal, spike, stuck and out of range runs over each series in order of time. What
it sees of a bar is its distance from the levels before and after it in units of the series' usual move, whether it
repeats the bar before, and the hard bounds. Width of the normal moves, rate of spikes, of chance repeats and of frozen
runs are fitted per series by expectation-maximisation on counts of all its bars; forward-backward probabilities with the
hard bounds then assign the state. Being stuck is a chain of five states, so that shorter runs of repeats cannot be it.

A series is cut into blocks of ``BLOCK`` bars with ``HALO`` bars of context on either side, so its length does not
bound what a task holds, and forward-backward steps through many blocks at once. Repeated copies of a bar are folded
into one before and get its flag back after.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scale import by_group, lookup_join
from ..session import drop_table, materialize

BLOCK, HALO = 1024, 64
#: Bars on one side that make up the level before or after a bar.
REACH = 7
#: Shortest frozen run: rows that repeat the bar before.
STUCK_RUN = 5
STATES = ["normal", "spike", "out_of_range", "stuck"]
PRICES = ["open", "high", "low", "close"]
#: Numbers of the model's states; a frozen run passes through all of the chain and stays in its last one.
NORMAL, SPIKE, OUT, CHAIN = 0, 1, 2, range(3, 3 + STUCK_RUN)

#: Moves of a normal bar follow a half t law of this many degrees of freedom, a spike's are spread evenly in log from
#: SPIKE_FROM widths of the series on.
FREEDOM, SPIKE_FROM, FARTHEST = 6.0, 8.0, 1e6
#: What is known before any bar is seen: rates of spikes and frozen runs with the bars that knowledge is worth, the chance
#: to stay in a spike or frozen, and the most that chance repeats may be.
SPIKE_RATE, STUCK_RATE, PRIOR_BARS = 1e-3, 4e-4, 1000.0
STAY_SPIKE, STAY_STUCK, MOST_REPEATS = 0.3, 0.9, 0.03
#: Bins of the distance, even in log, for the fit.
BINS, LOW, HIGH = 64, 1e-2, 1e4
EM_ROUNDS = 60
#: Blocks that go through forward-backward together.
TOGETHER = 256

_NEVER = 1e-12
_EDGES = np.geomspace(LOW, HIGH, BINS + 1)
_CENTRES = np.sqrt(_EDGES[1:] * _EDGES[:-1])


# --- what the model sees --------------------------------------------------------------------------------------------


def hard_fault(prices: np.ndarray) -> np.ndarray:
    """A price not above zero, low above high, or open or close outside low..high; nulls (NaN) make no fault."""
    o, h, lo, c = np.moveaxis(prices, -1, 0)
    with np.errstate(invalid="ignore"):
        return (prices <= 0).any(axis=-1) | (lo > h) | (o > h) | (o < lo) | (c > h) | (c < lo)


def _median(values: np.ndarray) -> np.ndarray:
    """Median along the last axis without NaN; NaN where there is none."""
    n = (~np.isnan(values)).sum(axis=-1)
    s = np.sort(values, axis=-1)  # NaN come last
    low, high = np.maximum((n - 1) // 2, 0), np.minimum(n // 2, values.shape[-1] - 1)
    pick = lambda i: np.take_along_axis(s, i[..., None], axis=-1)[..., 0]
    return np.where(n > 0, (pick(low) + pick(high)) / 2, np.nan)


def distances(prices: np.ndarray, hard: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """How far each bar's most distant price is from both the level before and the level after, in usual moves.

    Arrays are (blocks, bars, prices). Where one side has no bars, the bar's own open and close stand in for it, so a bar at
    the end counts by its other prices being back at the level. NaN where nothing is known.
    """
    with np.errstate(all="ignore"):
        logs = np.where(prices > 0, np.log(prices), np.nan)
        close = np.where(hard, np.nan, logs[..., 3])
        pad = np.pad(close, [(0, 0), (REACH, REACH)], constant_values=np.nan)
        view = np.lib.stride_tricks.sliding_window_view(pad, REACH, axis=1)
        before, after = _median(view[:, : close.shape[1]]), _median(view[:, REACH + 1 :])
        own = _median(np.where(hard[..., None], np.nan, logs[..., [0, 3]]))
        before, after = np.where(np.isnan(before), own, before), np.where(np.isnan(after), own, after)
        away = np.fmin(np.abs(logs - before[..., None]), np.abs(logs - after[..., None]))
        known = ~np.isnan(away).all(axis=-1)
        far = np.where(known, np.nanmax(np.where(np.isnan(away), -1.0, away), axis=-1), np.nan)
        z = np.where(usual[:, None] > 0, far / usual[:, None], np.where(far > 0, FARTHEST, far * 0))
    return np.minimum(z, FARTHEST)


def run_lengths(flag: np.ndarray) -> list[int]:
    """Length of each run of true values."""
    edge = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]]))
    return (np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)).tolist()


# --- the model --------------------------------------------------------------------------------------------------------


def normal_density(z: np.ndarray, width: np.ndarray) -> np.ndarray:
    # constant of the half t law of six degrees of freedom
    return 0.765466 / width * (1 + (z / width) ** 2 / FREEDOM) ** (-(FREEDOM + 1) / 2)


def spike_density(z: np.ndarray, width: np.ndarray) -> np.ndarray:
    from_ = SPIKE_FROM * width
    return np.where(z >= from_, 1 / (np.maximum(z, 1e-9) * np.log(np.maximum(FARTHEST / from_, 10.0))), _NEVER)


def fit_series(counts: np.ndarray, repeats: np.ndarray, frozen: np.ndarray, bars: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters of many series at once: ``width, spike, repeat, stuck``.

    ``counts`` (series, BINS) are binned distances, ``repeats`` the bars in runs too short to be frozen, ``frozen`` the
    number of longer runs. Width and spike rate alternate between the posterior of each bin and their best values given
    it; the chain leaves no doubt which repeats belong to a frozen run, so those rates are counted.
    """
    z = _CENTRES[None, :]
    n = counts.sum(axis=1)
    middle = np.take(_CENTRES, np.argmax(np.cumsum(counts, axis=1) >= n[:, None] / 2, axis=1))
    width, rate = np.maximum(middle, LOW), np.full(len(counts), SPIKE_RATE)
    for _ in range(EM_ROUNDS):
        calm = (1 - rate)[:, None] * normal_density(z, width[:, None])
        wild = rate[:, None] * spike_density(z, width[:, None])
        spike = wild / (calm + wild)
        mine = counts * (1 - spike)
        pull = (FREEDOM + 1) / (FREEDOM + (z / width[:, None]) ** 2)
        # one usual bar of distance one is known before
        width = np.maximum(np.sqrt(((mine * pull * z**2).sum(axis=1) + 1) / (mine.sum(axis=1) + 1)), LOW)
        rate = ((counts * spike).sum(axis=1) + SPIKE_RATE * PRIOR_BARS) / (n + PRIOR_BARS)
    repeat = np.minimum((repeats + 0.005 * PRIOR_BARS) / (bars + PRIOR_BARS), MOST_REPEATS)
    stuck = (frozen + STUCK_RATE * PRIOR_BARS) / (bars + PRIOR_BARS)
    return {"width": width, "spike": np.minimum(rate, 0.1), "repeat": repeat, "stuck": np.minimum(stuck, 0.1)}


def transitions(spike: np.ndarray, stuck: np.ndarray) -> np.ndarray:
    """Transition matrices (series, from, to)."""
    states = 3 + STUCK_RUN
    a = np.zeros((len(spike), states, states))
    out = SPIKE_RATE
    first, last = CHAIN[0], CHAIN[-1]
    for s, stay in ((NORMAL, 0.0), (SPIKE, STAY_SPIKE), (OUT, 0.0)):
        a[:, s, SPIKE] = np.maximum(spike, stay)
        a[:, s, OUT] = out
        a[:, s, first] = stuck
        a[:, s, NORMAL] = 1 - a[:, s, SPIKE] - out - stuck
    for s in CHAIN[:-1]:
        a[:, s, s + 1] = 1.0
    a[:, last, last] = STAY_STUCK
    a[:, last, NORMAL] = (1 - STAY_STUCK) * (1 - spike - out)
    a[:, last, SPIKE] = (1 - STAY_STUCK) * spike
    a[:, last, OUT] = (1 - STAY_STUCK) * out
    return a


def likelihoods(z: np.ndarray, repeat: np.ndarray, hard: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """Emission of each bar (blocks, bars) under each state; a bar of unknown distance says nothing about it."""
    width, r = p["width"][:, None], p["repeat"][:, None]
    known = ~np.isnan(z)
    zz = np.where(known, np.maximum(z, 1e-6), 1.0)
    calm, wild = (np.where(known, f(zz, width), 1.0) for f in (normal_density, spike_density))
    again = np.where(repeat, r, 1 - r)
    sound = np.where(hard, _NEVER, 1.0)
    out = np.empty((*z.shape, 3 + STUCK_RUN))
    out[..., NORMAL] = calm * again * sound
    out[..., SPIKE] = wild * again * sound
    out[..., OUT] = np.where(hard, 1.0, 0.0)
    # a feed can freeze at any price
    out[..., CHAIN[0] :] = (np.where(repeat, 1.0, 0.0) * sound * np.maximum(calm, wild))[..., None]
    return np.maximum(out, 1e-280)


def forward_backward(like: np.ndarray, trans: np.ndarray, length: np.ndarray) -> np.ndarray:
    """State probabilities (blocks, bars, states) of many sequences at once, each scaled at every step.

    Sequences are padded to the longest; padding has likelihood 1 and does not bear on what lies before it, except that
    the end of a sequence cannot lie within the first states of a frozen run.
    """
    n, bars, states = like.shape
    alpha, beta = np.empty_like(like), np.empty_like(like)
    a = trans[:, NORMAL] * like[:, 0]
    # the block may begin within a frozen run
    a[:, CHAIN[-1]] += 1e-3 * like[:, 0, CHAIN[-1]]
    alpha[:, 0] = a / a.sum(axis=1, keepdims=True)
    for t in range(1, bars):
        a = np.matmul(alpha[:, t - 1, None], trans)[:, 0] * like[:, t]
        alpha[:, t] = a / a.sum(axis=1, keepdims=True)
    end = np.ones(states)
    end[CHAIN[0] : CHAIN[-1]] = 0.0
    b = np.tile(end, (n, 1))
    beta[:, -1] = b
    for t in range(bars - 2, -1, -1):
        b = np.matmul(trans, (like[:, t + 1] * beta[:, t + 1])[..., None])[..., 0]
        b /= b.sum(axis=1, keepdims=True)
        beta[:, t] = np.where((t >= length - 1)[:, None], end, b)
    p = alpha * beta
    return p / p.sum(axis=2, keepdims=True)


def assign(p: np.ndarray, hard: np.ndarray) -> np.ndarray:
    """Number in STATES of each bar: the most probable state, out of range by its bounds."""
    merged = np.stack([p[..., NORMAL], p[..., SPIKE], p[..., OUT], p[..., CHAIN[0] :].sum(axis=-1)], axis=-1)
    return np.where(hard, OUT, merged.argmax(axis=-1))


def judge(prices: np.ndarray, volume: np.ndarray, usual: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number in STATES, state probabilities, distances) of one series in order of time; ``usual`` is its usual log move."""
    hard = hard_fault(prices)[None]
    z = distances(prices[None], hard, np.array([usual]))
    repeat = np.r_[False, (prices[1:] == prices[:-1]).all(axis=1)] & (np.nan_to_num(volume) > 0)
    seen, lengths = z[~hard & ~np.isnan(z)], run_lengths(repeat)
    counts = np.histogram(np.clip(seen, LOW, HIGH), _EDGES)[0][None].astype(float)
    p = fit_series(counts, np.array([sum(x for x in lengths if x < STUCK_RUN)]), np.array([sum(x >= STUCK_RUN for x in lengths)]), np.array([len(prices)]))
    prob = forward_backward(likelihoods(z, repeat[None], hard, p), transitions(p["spike"], p["stuck"]), np.array([len(prices)]))
    return assign(prob, hard)[0], prob[0], z[0]


# --- over the tables --------------------------------------------------------------------------------------------------

_SEEN = "series_id long, bar_id array<long>, z array<float>, repeat array<boolean>, hard array<boolean>, core_from int, core_to int, counts array<long>, repeats long, frozen long"
_FLAGS = "bar_id long, state string, p_spike double, p_stuck double, z double"


def _padded(parts: list[np.ndarray], size: int, fill: float) -> np.ndarray:
    out = np.full((len(parts), size, *parts[0].shape[1:]), fill)
    for i, p in enumerate(parts):
        out[i, : len(p)] = p
    return out


def _see(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block, from rows sorted by series, block and place."""

    def blocks(table: pa.Table, bounds: list[int]) -> Iterator[pa.RecordBatch]:
        get = lambda c: table[c].to_numpy()
        prices, volume = np.stack([get(c).astype(float) for c in PRICES], axis=1), get("volume").astype(float)
        usual, core, ids, series = np.nan_to_num(get("usual").astype(float)), get("core").astype(bool), get("bar_id"), get("series_id")
        # a block after the last full one may hold nothing but context
        own = [slice(a, b) for a, b in zip(bounds, bounds[1:]) if core[a:b].any()]
        for i in range(0, len(own), TOGETHER):
            some = own[i : i + TOGETHER]
            size = max(s.stop - s.start for s in some)
            px = _padded([prices[s] for s in some], size, np.nan)
            hard = hard_fault(px)
            z = distances(px, hard, usual[[s.start for s in some]])
            repeat = np.zeros(hard.shape, bool)
            repeat[:, 1:] = (px[:, 1:] == px[:, :-1]).all(axis=2)
            repeat &= _padded([np.nan_to_num(volume[s]) for s in some], size, 0.0) > 0
            rows: dict[str, list] = {c.split()[0]: [] for c in _SEEN.split(", ")}
            for k, s in enumerate(some):
                n, inside = s.stop - s.start, np.flatnonzero(core[s])
                mine = slice(inside[0], inside[-1] + 1)
                seen = z[k, mine][~hard[k, mine] & ~np.isnan(z[k, mine])]
                lengths = run_lengths(repeat[k, mine])
                values = (
                    series[s.start], ids[s], z[k, :n].astype(np.float32), repeat[k, :n], hard[k, :n], mine.start, mine.stop,
                    np.histogram(np.clip(seen, LOW, HIGH), _EDGES)[0], sum(x for x in lengths if x < STUCK_RUN), sum(x >= STUCK_RUN for x in lengths),
                )
                for c, v in zip(rows, values):
                    rows[c].append(v)
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float32()), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds)], names=list(rows))

    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        series, block = table["series_id"].to_numpy(), table["block"].to_numpy()
        cut = [0, *(np.flatnonzero((np.diff(series) != 0) | (np.diff(block) != 0)) + 1).tolist()]
        # the last block may go on in the next batch
        yield from blocks(table, cut)
        held = table.slice(cut[-1])
    if held is not None and held.num_rows:
        yield from blocks(held, [0, held.num_rows])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            get = lambda c: batch[c].to_numpy(zero_copy_only=False).astype(float)
            p = fit_series(np.stack([get(f"c{i}") for i in range(BINS)], axis=1), get("repeats"), get("frozen"), get("bars"))
            yield pa.RecordBatch.from_arrays([batch["series_id"], *map(pa.array, p.values())], names=["series_id", *p])


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.asarray(batch["z"].offsets)
        flat = {c: batch[c].values.to_numpy(zero_copy_only=False) for c in ("bar_id", "z", "repeat", "hard")}
        core_from, core_to = batch["core_from"].to_numpy(), batch["core_to"].to_numpy()
        p = {c: batch[c].to_numpy() for c in ("width", "spike", "repeat_rate", "stuck")}
        p["repeat"] = p.pop("repeat_rate")
        # blocks of like length go together
        order = np.argsort(np.diff(at), kind="stable")
        for i in range(0, len(order), TOGETHER):
            some = order[i : i + TOGETHER]
            length = np.diff(at)[some]
            cells = [slice(at[k], at[k + 1]) for k in some]
            z = _padded([flat["z"][c].astype(float) for c in cells], int(length.max()), np.nan)
            repeat, hard = (_padded([flat[name][c] for c in cells], int(length.max()), 0.0) > 0 for name in ("repeat", "hard"))
            mine = {c: v[some] for c, v in p.items()}
            prob = forward_backward(likelihoods(z, repeat, hard, mine), transitions(mine["spike"], mine["stuck"]), length)
            state = assign(prob, hard)
            keep = [(row, slice(core_from[k], core_to[k])) for row, k in enumerate(some)]
            take = lambda x: np.concatenate([x[row, part] for row, part in keep])
            distance = take(z)
            columns = [
                pa.array(np.concatenate([flat["bar_id"][c][part] for c, (_, part) in zip(cells, keep)]), pa.int64()),
                pa.array(np.array(STATES, object)[take(state)], pa.string()),
                pa.array(np.round(take(prob[..., SPIKE]), 6)),
                pa.array(np.round(take(prob[..., CHAIN[0] :].sum(axis=-1)), 6)),
                pa.array(np.round(distance, 3), mask=np.isnan(distance)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _FLAGS.split(", ")])


def flag_bars(bars: DataFrame) -> DataFrame:
    """``bar_id, state, p_spike, p_stuck, z``, one row per input row; state is one of STATES.

    Input: ``bar_id, series_id, time, open, high, low, close, volume``; other columns are ignored. Bars of one series
    follow time, then bar_id; a null time comes first, and null series ids form one series. Rows equal in series, time,
    prices and volume are copies of one bar and share its state. Null prices make no fault of their own, NaN counts as
    null, and ``z`` is null where no price is known. Empty input gives an empty result.
    """
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c)
    x = bars.select(F.col("bar_id").cast("long").alias("bar_id"), F.coalesce(F.col("series_id").cast("long"), F.lit(-(2**62))).alias("series_id"), F.col("time").cast("timestamp_ntz").alias("time"), *[number(c) for c in [*PRICES, "volume"]])
    keys = ["series_id", "time", *PRICES, "volume"]
    # buckets in order of time; bars without time go by their ids
    bucket = F.coalesce(F.datediff(F.to_date("time"), F.lit("1970-01-01").cast("date")).cast("long"), F.floor(F.col("bar_id") / 65_536) - 2**48)
    spread = x.withColumn("bucket", bucket).repartition("series_id", "bucket")
    # one shuffle serves the folding and the order within a bucket
    folded = spread.groupBy("bucket", *keys).agg(F.min("bar_id").alias("bar_id"), F.count("*").alias("copies"))
    w = Window.partitionBy("series_id", "bucket").orderBy("time", "bar_id")
    log = F.ln(F.when(F.col("close") > 0, F.col("close")))
    placed = folded.withColumns({"_in": F.row_number().over(w) - 1, "_move": F.abs(log - F.lag(log).over(w)).cast("float")})
    placed = materialize(placed, "bars")
    sizes = placed.groupBy("series_id", "bucket").agg(F.count("*").alias("_n"))
    by_bucket = Window.partitionBy("series_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(sizes.select("series_id", "bucket", F.coalesce(F.sum("_n").over(by_bucket), F.lit(0)).alias("_before")), "starts")
    usual = materialize(placed.where("_move > 0").groupBy("series_id").agg(F.percentile_approx("_move", 0.5, 1000).alias("usual")), "usual")

    rank = F.col("_before") + F.col("_in")
    block, place = F.floor(rank / BLOCK), rank % BLOCK
    homes = F.array_compact(F.array(block, F.when((place < HALO) & (block > 0), block - 1), F.when(place >= BLOCK - HALO, block + 1)))
    rows = lookup_join(placed, starts, ["series_id", "bucket"]).select("bar_id", "series_id", *PRICES, "volume", rank.alias("rank"), block.alias("_home"), F.explode(homes).alias("block"))
    rows = lookup_join(rows.withColumn("core", F.col("_home") == F.col("block")).drop("_home"), usual, ["series_id"])
    seen = by_group(rows, "series_id", "block").sortWithinPartitions("series_id", "block", "rank").mapInArrow(_see, _SEEN)
    seen = materialize(seen, "seen")
    told = seen.groupBy("series_id").agg(*[F.sum(F.get("counts", F.lit(i))).alias(f"c{i}") for i in range(BINS)], F.sum("repeats").alias("repeats"), F.sum("frozen").alias("frozen"), F.sum(F.col("core_to") - F.col("core_from")).alias("bars"))
    fitted = materialize(told.mapInArrow(_fit, "series_id long, width double, spike double, repeat double, stuck double").withColumnRenamed("repeat", "repeat_rate"), "fitted")
    judged = lookup_join(seen.select("series_id", "bar_id", "z", "repeat", "hard", "core_from", "core_to"), fitted, ["series_id"], "inner").mapInArrow(_judge, _FLAGS)

    # copies take the state of the bar they repeat; bars that have copies are looked up by a hash, then compared
    judged = materialize(judged, "judged")
    drop_table(seen)
    same = F.xxhash64(*keys)
    twins = placed.where("copies > 1").select(same.alias("_k"), F.struct(*keys).alias("_bar"), F.col("bar_id").alias("_first")).join(judged.withColumnRenamed("bar_id", "_first"), "_first")
    copies = lookup_join(x.select("bar_id", same.alias("_k"), F.struct(*keys).alias("_own")), materialize(twins, "twins"), ["_k"], "inner")
    copies = copies.where(F.col("_own").eqNullSafe(F.col("_bar")) & (F.col("bar_id") != F.col("_first")))
    return judged.unionByName(copies.select(*judged.columns))

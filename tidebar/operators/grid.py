"""Irregular readings on a regular grid, missing periods filled and marked (problem 3).

Readings fall into periods; a source's periods from its first to its last are cut into segments of bounded length. In
each segment the missing values are filled by iterative singular-spectrum imputation: the series is embedded in a
Hankel matrix, its leading singular vectors are kept, the anti-diagonal means replace the missing entries, and this
repeats until they settle. After some plain rounds each one goes on to where further rounds in the same subspace would
lead, which a linear system says, and steps are extrapolated on the way (Varadhan and Roland's SQUAREM); what ends them
is still a plain round that changes nothing, met in fewer rounds. Every period without a reading is marked, and so is
whether its value is filled, and whether it had settled at ROUNDS.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import by_group, lookup_join
from ..session import materialize
from .timestamps import normalise_timestamps

#: Periods of a tick segment, and periods of its neighbours it is filled with; bar segments are sessions of a day.
SEGMENT, CONTEXT = 1024, 48
#: Embedding window; leading components kept at most, or fewer where those hold ENERGY of the matrix, and never more than a
#: third of the window; the rounds at which a segment that does not settle is given up, and the change (in standard
#: deviations) that ends them.
WINDOW, ENERGY, RANK, ROUNDS, TOLERANCE = 24, 0.98, 8, 10_000, 2e-3
#: Longest extrapolation at first, in steps.
LEAP = 32.0
#: Plain rounds before they go on in their subspace, and the damping of that: it leads as far as about 1 / DAMP rounds do.
PLAIN, DAMP = 12, 0.01
MINUTE_US = 60_000_000

_SCHEMA = "source_id long, slot_us long, value double, missing boolean, filled boolean, settled boolean"


def ssa_impute(values: np.ndarray, window: int = WINDOW, energy: float = ENERGY, rank: int = RANK, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Copy of ``values`` with NaN replaced; without any value they stay NaN."""
    return ssa_settle(values, window, energy, rank, rounds, tolerance)[0]


def ssa_settle(values: np.ndarray, window: int = WINDOW, energy: float = ENERGY, rank: int = RANK, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, bool]:
    """The same, and whether a last plain round changed no value by ``tolerance``.

    A short series has a shorter window. Equal values, or a single one, are carried on, as all their components say.
    """
    miss = np.isnan(values)
    have = np.flatnonzero(~miss)
    if not miss.any() or not len(have):
        return values.copy(), True
    n = len(values)
    seen = values[have]
    centre, spread = seen.mean(), seen.std()
    if n < 3 or not spread > 0:
        return np.where(miss, centre, values), True
    x = (np.interp(np.arange(n), have, seen) - centre) / spread
    gone = np.flatnonzero(miss)
    k = max(2, min(window, n // 2))
    most = max(1, min(rank, k // 3))
    wide = n - k + 1
    counts = np.minimum(np.minimum(gone + 1, n - gone), min(k, wide)).astype(float)
    step = x.strides[0]
    hankel = np.lib.stride_tricks.as_strided(x, (k, wide), (step, step))
    # rows of n + 1 read as rows of n: each moves on by its number, so anti-diagonals become columns
    shifted = np.zeros((k, n + 1))
    rows, diagonals = shifted[:, :wide], shifted.ravel()[: k * n].reshape(k, n)
    kept, spent, settled, inner = 1, 0, False, None
    now, leap = x[gone], LEAP
    last = now

    def advance(at: np.ndarray) -> np.ndarray:
        """One round from the missing entries ``at``, which ``last`` holds; after PLAIN rounds, where more in its subspace lead."""
        nonlocal kept, spent, settled, last, inner
        spent += 1
        x[gone] = at
        weights, vectors = np.linalg.eigh(hankel @ hankel.T)
        # the rank may grow but not fall, else it can flip for ever
        if kept < most:
            kept = max(kept, min(most, int(np.searchsorted(np.cumsum(weights[::-1]), energy * weights.sum())) + 1))
        lead = vectors[:, -kept:]
        np.matmul(lead, lead.T @ hankel, out=rows)
        last = diagonals.sum(axis=0)[gone] / counts
        move = last - at
        settled = bool(np.abs(move).max() < tolerance)
        if settled or spent <= PLAIN:
            return last
        inner = inner or _inner_system(gone, k, wide, counts)
        return at + np.linalg.solve(inner(lead @ lead.T), move)

    while spent < rounds:
        one = advance(now)
        if settled:
            break
        two = advance(one)
        if settled:
            break
        first, turn = one - now, (two - one) - (one - now)
        size, bend = np.sqrt(first @ first), np.sqrt(turn @ turn)
        far = min(max(size / bend if bend > 0 else leap, 1.0), leap)
        ahead = now + 2 * far * first + far * far * turn
        landed = advance(ahead)
        if settled:
            break
        # the next extrapolations may be longer where one as long as allowed ends nearer to rest than it began; one that
        # ends farther is dropped, and the next are shorter
        off = landed - ahead
        if np.sqrt(off @ off) <= size:
            now, leap = landed, 2 * leap if far == leap and bend > 0 else leap
        else:
            now, leap = two, max(leap / 2, 1.0)
    out = values.copy()
    # what is filled stays within what was seen
    out[gone] = np.clip((last if settled else now) * spread + centre, seen.min(), seen.max())
    return out, settled


def _inner_system(gone: np.ndarray, k: int, wide: int, counts: np.ndarray):
    """From a projector, the damped matrix of the missing entries' move per round: what its solution adds, no round in the subspace changes."""
    span = 2 * k - 1
    # entry t takes from entry t + lag the sum of the projector's diagonal ``lag`` over the rows whose columns t is in
    lag = gone[None, :] - gone[:, None] + k - 1
    near = (lag >= 0) & (lag < span)
    lag = np.clip(lag, 0, span - 1)
    begin = np.maximum(0, gone - wide + 1)[:, None] * span + lag
    end = (np.minimum(k - 1, gone) + 1)[:, None] * span + lag
    weight = near / counts[:, None]
    row = np.arange(k)[:, None]
    place = row * span + np.arange(k)[None, :] - row + k - 1
    skewed, sums, own = np.zeros((k, span)), np.zeros((k + 1, span)), np.arange(len(gone))

    def system(projector: np.ndarray) -> np.ndarray:
        skewed.ravel()[place] = projector
        np.cumsum(skewed, axis=0, out=sums[1:])
        flat = sums.ravel()
        matrix = (flat[begin] - flat[end]) * weight
        matrix[own, own] += 1.0 + DAMP
        return matrix

    return system


def _fill(impute: bool):
    """Rows are segments ``source_id, period_us, parts, readings``; periods run on over the parts, which have grids of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, slots, values, absent, calm = [], [], [], [], []
            source, period = batch["source_id"].to_numpy(), batch["period_us"].to_numpy()
            part_at, parts = np.asarray(batch["parts"].offsets), batch["parts"].values
            base, first, size, cut_a, cut_b = (parts.field(c).to_numpy(zero_copy_only=False) for c in ("base_us", "first", "n", "cut_a", "cut_b"))
            read_at, reads = np.asarray(batch["readings"].offsets), batch["readings"].values
            when, value = reads.field("slot_us").to_numpy(zero_copy_only=False), reads.field("value").to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                grids = []
                for j in range(part_at[i], part_at[i + 1]):
                    place = np.arange(first[j], first[j] + size[j], dtype=np.int64)
                    grids.append(base[j] + place[(place < cut_a[j]) | (place >= cut_b[j])] * period[i])
                grid = np.concatenate(grids) if grids else np.zeros(0, np.int64)
                if not len(grid):
                    continue
                t, v = when[read_at[i] : read_at[i + 1]], value[read_at[i] : read_at[i + 1]]
                # the grid reaches into the neighbours as far as their readings do
                lead = np.arange(grid[0] - period[i], (t.min() if len(t) else grid[0]) - 1, -period[i])[::-1]
                tail = np.arange(grid[-1] + period[i], (t.max() if len(t) else grid[-1]) + 1, period[i])
                whole = np.concatenate([lead, grid, tail])
                at = np.searchsorted(whole, t)
                met = (at < len(whole)) & (whole[np.minimum(at, len(whole) - 1)] == t)
                series = np.full(len(whole), np.nan)
                series[at[met]] = v[met]
                core = slice(len(lead), len(lead) + len(grid))
                missing = np.isnan(series[core])
                filled, settled = ssa_settle(series) if impute and missing.any() else (series, True)
                ids.append(np.full(len(grid), source[i]))
                slots.append(grid)
                absent.append(missing)
                values.append(filled[core])
                calm.append(~missing | settled)
            if not ids:
                continue
            v, gone = np.concatenate(values), np.concatenate(absent)
            columns = [pa.array(np.concatenate(ids), pa.int64()), pa.array(np.concatenate(slots), pa.int64()), pa.array(v, mask=np.isnan(v)), pa.array(gone), pa.array(gone & ~np.isnan(v)), pa.array(np.concatenate(calm))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SCHEMA.split(", ")])

    return run


def _segments(segments: DataFrame, impute: bool) -> DataFrame:
    x = segments.select("source_id", "period_us", "parts", "readings")
    if impute:  # the work lies in the segments, so they are spread evenly
        x = by_group(x, "source_id", x["parts"][0]["base_us"])
    return x.mapInArrow(_fill(impute), _SCHEMA)


_PART = "struct<base_us:bigint,first:int,n:int,cut_a:int,cut_b:int>"


def tick_grid(ticks: DataFrame, feeds: DataFrame, period_us: int = MINUTE_US, impute: bool = True) -> DataFrame:
    """Last bid per period of every file: ``source_id`` (file_id), ``slot_us, value, missing, filled, settled``.

    A reading is a row whose text names one instant and whose bid is above zero (NaN and null are none); of several in
    a period the last counts, ties by tick_id. A file without readings has no periods, and rows without file are ignored.
    A missing period is filled unless its segment and CONTEXT periods around it hold no reading; without ``impute`` none is.
    """
    x = normalise_timestamps(ticks, feeds, "tick_id", "dt", keep=("file_id", "bid")).where("utc_us is not null and bid > 0 and not isnan(bid) and file_id is not null")
    per_slot = x.groupBy("file_id", F.floor(F.col("utc_us") / period_us).alias("slot")).agg(F.max_by("bid", F.struct("utc_us", "row_id")).alias("value"))
    per_slot = materialize(per_slot, "slots")
    seg = F.floor(F.col("slot") / SEGMENT)
    place = F.col("slot") - seg * SEGMENT
    # readings near an end also go to the neighbour
    homes = F.array_compact(F.array(seg, F.when(place < CONTEXT, seg - 1), F.when(place >= SEGMENT - CONTEXT, seg + 1))) if impute else F.array(seg)
    readings = per_slot.select("file_id", F.explode(homes).alias("seg"), F.struct((F.col("slot") * period_us).alias("slot_us"), "value").alias("r")).groupBy("file_id", "seg").agg(F.collect_list("r").alias("readings"))
    spans = per_slot.groupBy("file_id").agg(F.min("slot").alias("a"), F.max("slot").alias("b"))
    every = spans.select("file_id", "a", "b", F.explode(F.sequence(F.floor(F.col("a") / SEGMENT), F.floor(F.col("b") / SEGMENT))).alias("seg"))
    first = F.greatest(F.col("a") - F.col("seg") * SEGMENT, F.lit(0)).cast("int")
    last = F.least(F.col("b") - F.col("seg") * SEGMENT, F.lit(SEGMENT - 1)).cast("int")
    part = F.struct((F.col("seg") * SEGMENT * period_us).alias("base_us"), first.alias("first"), (last - first + 1).alias("n"), F.lit(2**30).alias("cut_a"), F.lit(2**30).alias("cut_b"))
    segments = every.join(readings, ["file_id", "seg"], "left").select(
        F.col("file_id").cast("long").alias("source_id"), F.lit(period_us).cast("long").alias("period_us"), F.array(part).cast(f"array<{_PART}>").alias("parts"), F.coalesce("readings", F.expr("cast(array() as array<struct<slot_us:bigint,value:double>>)")).alias("readings")
    )
    return _segments(segments, impute)


def bar_grid(bars: DataFrame, series: DataFrame, closed: tuple[int, int] = (17, 18), session_shift_h: int = 6, impute: bool = True) -> DataFrame:
    """Volume per period of every bar series: ``source_id`` (series_id), ``slot_us`` (own clock), ``value, missing, filled, settled``.

    Periods are multiples of ``period_s`` from midnight, on session dates (date of slot + 6 h) with a row of the series
    and outside the closed hours, from the period of the series' first row to that of its last. A reading is a row with
    a volume (NaN counts as null); of several in a period the last loaded counts, ties by bar_id. Rows without time and
    series without a positive period are ignored. A segment is one session, so at most a day; one without a reading stays
    missing and unfilled, and without ``impute`` all do.
    """
    periods = series.groupBy(F.col("series_id").cast("long").alias("series_id")).agg((F.max("period_s") * F.lit(1_000_000)).cast("long").alias("p")).where("p > 0")
    x = bars.select(F.col("series_id").cast("long").alias("series_id"), F.col("time").cast("timestamp_ntz").alias("time"), F.nanvl(F.col("volume").cast("double"), F.lit(None).cast("double")).alias("volume"), F.struct("loaded_at", "bar_id").alias("_k")).where("time is not null")
    day0 = F.lit("1970-01-01").cast("date")
    day = F.datediff(F.to_date("time"), day0).cast("long")
    clock = ((F.hour("time") * 3600 + F.minute("time") * 60).cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), F.col("time")) * 1_000_000).cast("long"))
    x = lookup_join(x.withColumns({"_day": day, "_clock": clock}), materialize(periods, "periods"), ["series_id"], "inner")
    day_us = 86_400 * 1_000_000
    x = x.withColumn("slot_us", F.col("_day") * day_us + F.floor(F.col("_clock") / F.col("p")) * F.col("p"))
    shift = session_shift_h * 3600 * 1_000_000
    session = F.floor((F.col("slot_us") + shift) / day_us)
    per_slot = x.groupBy("series_id", "p", "slot_us").agg(F.max_by("volume", F.when(F.col("volume").isNotNull(), F.col("_k"))).alias("value"))
    per_slot = materialize(per_slot.withColumn("session", session), "slots")
    # a session's periods are those of its evening before midnight and of the day after; places count from its start
    start = F.col("session") * day_us - shift
    spans = per_slot.groupBy("series_id").agg(F.min("slot_us").alias("a"), F.max("slot_us").alias("b"))
    by_session = per_slot.groupBy("series_id", "p", "session").agg(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("slot_us", "value"))).alias("readings"))
    s = by_session.join(spans, "series_id").withColumn("start", start)
    # each part of a session lies on one calendar day, where periods are multiples from midnight
    parts = F.array(
        F.struct((F.col("session") * day_us - day_us).alias("midnight"), F.col("start").alias("lo"), (F.col("session") * day_us).alias("hi")),
        F.struct((F.col("session") * day_us).alias("midnight"), (F.col("session") * day_us).alias("lo"), (F.col("start") + day_us).alias("hi")),
    )
    p = F.col("p")
    hour = 3_600_000_000
    cut = lambda h: F.ceil(F.lit(h * hour) / p).cast("int")

    def on_grid(part: Column) -> Column:
        up = lambda us: F.ceil((us - part["midnight"]) / p)
        first = up(F.greatest(part["lo"], F.col("a")))
        after = F.least(up(part["hi"]), F.floor((F.col("b") - part["midnight"]) / p) + 1)
        return F.struct(part["midnight"].alias("base_us"), first.cast("int").alias("first"), (after - first).cast("int").alias("n"), cut(closed[0]).alias("cut_a"), cut(closed[1]).alias("cut_b"))

    inside = F.filter(F.transform(F.filter(parts, lambda x: (x["lo"] <= F.col("b")) & (x["hi"] > F.col("a"))), on_grid), lambda x: x["n"] > 0)
    segments = s.select(F.col("series_id").alias("source_id"), p.alias("period_us"), inside.cast(f"array<{_PART}>").alias("parts"), "readings").where(F.size("parts") > 0)
    return _segments(segments, impute)


def slot_text(us: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` of microseconds, independent of the session's zone."""
    seconds = F.floor(us / 1_000_000)
    clock = F.pmod(seconds, F.lit(86_400))
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86_400).cast("int")).cast("string")
    two = lambda v: F.lpad(v.cast("int").cast("string"), 2, "0")
    return F.concat(date, F.lit(" "), two(F.floor(clock / 3600)), F.lit(":"), two(F.floor(clock % 3600 / 60)), F.lit(":"), two(clock % 60))

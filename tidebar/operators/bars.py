"""Ticks to bars: tumbling aggregation, the trading calendar, gap-free grids and forward filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import last_known

#: The trading day starts at 18:00 and the market is closed from 17:00 to 18:00.
SESSION_START, CLOSED_FROM, CLOSED_TO = 18, 17, 18


def session_date(ts: Column) -> Column:
    """Trading day of a time: from 18:00 on it is the next calendar day."""
    return F.to_date(ts + F.expr(f"interval {24 - SESSION_START} hours"))


def in_closed_hour(ts: Column) -> Column:
    return (F.hour(ts) >= CLOSED_FROM) & (F.hour(ts) < CLOSED_TO)


def price(source: str) -> Column:
    """Price column of a quote: ``bid``, ``ask`` or ``mid``."""
    prices = {"bid": F.col("bid"), "ask": F.col("ask"), "mid": (F.col("bid") + F.col("ask")) / 2}
    if source not in prices:
        raise ValueError(f"price source must be one of {sorted(prices)}, not {source!r}")
    return prices[source]


def number_in(text: Column) -> Column:
    """First number in a text, null if it has none."""
    return F.regexp_extract(text, r"([-+]?\d*\.?\d+)", 1).try_cast("double")


def compact_time(text: Column) -> Column:
    """``yyyyMMdd HHmmssSSS`` as a timestamp without zone; six digits have no fraction, other shapes are null."""
    t = F.trim(text)
    parts = [F.substring(t, a, n) for a, n in ((1, 4), (5, 2), (7, 2), (10, 2), (12, 2), (14, 2))]
    body = F.concat_ws("", parts[0], F.lit("-"), parts[1], F.lit("-"), parts[2], F.lit(" "), parts[3], F.lit(":"), parts[4], F.lit(":"), parts[5], F.lit("."), F.rpad(F.substring(t, 16, 3), 3, "0"))
    return F.when(t.rlike(r"^\d{8} \d{6,9}$"), body.try_cast("timestamp_ntz"))


def fixed_to_utc(ts: Column, offset_hours: int = -5) -> Column:
    """A reading of a clock with a fixed offset as one of UTC; the clock is never shifted, so neither is the offset."""
    return ts - F.make_dt_interval(hours=F.lit(offset_hours))


def tick_bars(ticks: DataFrame, seconds: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """OHLCV bars of ``ts, seq, px, vol``: left-closed, labelled by their start; ties in ts go by seq.

    Rows without ts or px are dropped. The buckets are epoch-anchored, so ``seconds`` must divide a day. Aggregates are
    partial on the map side; a hot symbol spreads over its buckets.
    """
    if seconds <= 0 or 86_400 % seconds:
        raise ValueError("the bar length must divide a day")
    x = ticks.where("ts is not null and px is not null")
    bucket = F.window("ts", f"{seconds} seconds")["start"]
    order = F.struct("ts", "seq")
    return (
        x.groupBy(*keys, bucket.alias("ts_bar"))
        .agg(F.min_by("px", order).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", order).alias("close"), F.sum("vol").alias("vol_sum"), F.count("*").alias("tick_count"))
        .withColumnRenamed("ts_bar", "ts")
    )


def volume_source(bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Per input: whether its volumes add up to more than zero, else the tick count stands for volume."""
    return bars.groupBy(*keys).agg((F.coalesce(F.sum("vol_sum"), F.lit(0.0)) > 0).alias("has_volume"))


def with_volume(bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    source = volume_source(bars, keys)
    volume = F.when(F.col("has_volume"), F.coalesce("vol_sum", F.lit(0.0))).otherwise(F.col("tick_count").cast("double"))
    return bars.join(source, list(keys)).withColumn("volume", volume).drop("has_volume", "vol_sum", "tick_count")


def trading_grid(ticks: DataFrame, seconds: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """All bar starts from floor(first tick) to ceil(last tick) on days with a tick, outside the closed hour."""
    us = seconds * 1_000_000
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    spans = ticks.where("ts is not null").groupBy(*keys).agg(F.floor(F.min(micros) / us).alias("a"), F.ceil(F.max(micros) / us).alias("b"))
    days = ticks.where("ts is not null").select(*keys, session_date(F.col("ts")).alias("session")).distinct()
    per_day = 86_400 // seconds
    start = F.floor((F.unix_micros(F.col("session").cast("timestamp")) - (24 - SESSION_START) * 3_600_000_000) / us)
    # one row per day is widened to its own day's slots only
    slots = days.join(spans, list(keys)).withColumn("slot", F.explode(F.sequence(F.greatest(start, F.col("a")), F.least(start + per_day - 1, F.col("b")))))
    slots = slots.where(F.col("slot").between(F.col("a"), F.col("b")))
    ts = F.timestamp_micros(F.col("slot") * us).cast("timestamp_ntz")
    return slots.select(*keys, "session", ts.alias("ts")).where(~in_closed_hour(F.col("ts")))


def filled_bars(ticks: DataFrame, seconds: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Gap-free bars: the last close is carried on (open, high and low take it), volume is 0, leading gaps are dropped."""
    bars = with_volume(tick_bars(ticks, seconds, keys).where(~in_closed_hour(F.col("ts"))), keys)
    on = trading_grid(ticks, seconds, keys).where("session is not null").join(bars, [*keys, "ts"], "left")
    return forward_fill(on, keys)


def forward_fill(grid: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Carry the close over gaps, session by session."""
    x = last_known(grid, list(keys), "session", ["ts"], "close", "_c").where("_c is not null")
    return x.select(*keys, "ts", *[F.coalesce(c, "_c").alias(c) for c in ("open", "high", "low")], F.col("_c").alias("close"), F.coalesce("volume", F.lit(0.0)).alias("volume"))

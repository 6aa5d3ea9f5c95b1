"""Checks of bars of unknown origin: column roles, bar period, precision, faulty rows."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-8
LEAST_VALID, MOST_BAD = 0.8, 0.05
HEAD_ROWS = 50


def try_number(c: str) -> Column:
    return F.col(c).try_cast("double")


def valid_ohlc(o: Column, h: Column, lo: Column, c: Column, eps: float = EPSILON) -> Column:
    """The five order relations of a bar, each with a tolerance; null prices make it null."""
    return (h + eps >= o) & (h + eps >= c) & (lo - eps <= o) & (lo - eps <= c) & (h + eps >= lo)


def bad_bar(ts: str = "ts") -> Column:
    """Strict fault: a missing time or price, low above high, open or close outside low..high."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    missing = F.col(ts).isNull() | o.isNull() | h.isNull() | lo.isNull() | c.isNull()
    return missing | F.coalesce((lo > h) | (o < lo) | (o > h) | (c < lo) | (c > h), F.lit(False))


def validity(df: DataFrame, keys: list[str]) -> DataFrame:
    cols = [F.col(x) for x in ("open", "high", "low", "close")]
    return df.groupBy(*keys).agg(F.avg(F.coalesce(valid_ohlc(*cols), F.lit(False)).cast("double")).alias("validity"), F.count("*").alias("n"))


def permutation_scores(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Validity of every assignment of four columns to open, high, low, close, all in one pass: ``keys, perm, score``."""
    perms = list(permutations(range(4)))
    scores = [F.avg(F.coalesce(valid_ohlc(*[F.col(columns[i]) for i in p]), F.lit(False)).cast("double")).alias(f"p{k}") for k, p in enumerate(perms)]
    one = df.groupBy(*keys).agg(*scores)
    rows = F.array(*[F.struct(F.lit(k).alias("perm"), F.lit("".join("ohlc"[p.index(i)] for i in range(4))).alias("roles"), F.col(f"p{k}").alias("score")) for k, p in enumerate(perms)])
    return one.select(*keys, F.explode(rows).alias("s")).select(*keys, "s.*")


def best_permutation(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Roles of the columns by the best score; among equals the first in lexicographic order of (open, high, low, close)."""
    s = permutation_scores(df, columns, keys)
    return s.groupBy(*keys).agg(F.max_by(F.struct("roles", "score"), F.struct("score", -F.col("perm"))).alias("b")).select(*keys, "b.roles", "b.score")


def detect_roles(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Column for each of open, high, low, close; raises if even the best order is valid for under 80 % of the rows."""
    best = best_permutation(df.withColumn("_one", F.lit(1)), columns, ["_one"]).first()
    if best is None or (best["score"] or 0.0) < LEAST_VALID:
        raise ValueError("no order of the columns gives plausible bars")
    names = {"o": "open", "h": "high", "l": "low", "c": "close"}
    return {names[r]: columns[i] for i, r in enumerate(best["roles"])}


def bad_bar_report(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    r = df.groupBy(*keys).agg(F.count_if(bad_bar(ts)).alias("bad"), F.count("*").alias("n")).withColumn("ratio", F.col("bad") / F.col("n"))
    return r.withColumn("accepted", F.col("ratio") <= MOST_BAD)


def apply_bad_bar_policy(df: DataFrame, policy: str = "keep", ts: str = "ts") -> DataFrame:
    """``keep``: raise above 5 % bad rows, else leave them in; ``drop``: the same but without them; ``fail``: raise on any."""
    if policy not in ("keep", "drop", "fail"):
        raise ValueError(f"unknown policy {policy!r}")
    bad, n = df.agg(F.count_if(bad_bar(ts)), F.count("*")).first()
    if n and (bad / n > MOST_BAD or (policy == "fail" and bad)):
        sample = df.where(bad_bar(ts)).limit(8).collect()
        raise ValueError(f"{bad} of {n} bars are faulty, e.g. {sample}")
    return df.where(~bad_bar(ts)) if policy == "drop" else df


def period_label(seconds: Column) -> Column:
    """``15s``, ``5min``, ``2h``, ``1d``: the largest unit that is not above the period, cut to whole units."""
    text = lambda n, unit: F.concat(F.floor(seconds / n).cast("string"), F.lit(unit))
    return F.when(seconds < 60, text(1, "s")).when(seconds < 3_600, text(60, "min")).when(seconds < 86_400, text(3_600, "h")).otherwise(text(86_400, "d"))


def exact_period_label(seconds: Column) -> Column:
    """``2h`` or ``5m`` only where they are exact, else seconds; ``unknown`` for a missing period."""
    s = F.round(seconds).cast("long")
    text = lambda n, unit: F.concat(F.floor(s / n).cast("string"), F.lit(unit))
    return F.when(s.isNull(), "unknown").when((s >= 60) & (s % 3_600 == 0), text(3_600, "h")).when((s >= 60) & (s % 60 == 0), text(60, "m")).otherwise(text(1, "s"))


def head_period(df: DataFrame, keys: list[str], ts: str = "ts", index: str = "bar_idx") -> DataFrame:
    """Bar period from the median of the first 50 deltas, as they are: ``keys, seconds, label``.

    Only the head of each key is read into its window; a median that is missing or not above zero gives nulls.
    """
    head = df.where(F.col(index) <= HEAD_ROWS)
    step = head.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t")))), lambda s: s["t"]).alias("t"))
    d = F.zip_with(F.slice("t", 2, HEAD_ROWS), F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))), lambda b, a: (b - a) / 1e6)
    deltas = step.select(*keys, F.explode_outer(F.filter(d, lambda v: v.isNotNull())).alias("d"))
    m = deltas.groupBy(*keys).agg(F.percentile("d", 0.5).alias("m"))
    seconds = F.when(F.col("m") > 0, F.floor("m").cast("long"))
    return m.select(*keys, seconds.alias("seconds"), period_label(seconds).alias("label"))


def all_period(deltas: DataFrame, keys: list[str], delta: str = "delta_s") -> DataFrame:
    """Bar seconds as the median of all positive finite deltas."""
    return deltas.where(F.col(delta) > 0).groupBy(*keys).agg(F.percentile(delta, 0.5).alias("seconds"))


def decimals(value: Column) -> Column:
    """Decimal places of a number as written; an exponent shifts them."""
    text = F.lower(value.cast("string"))
    fraction = F.length(F.regexp_replace(F.regexp_extract(text, r"\.(\d+)", 1), "0+$", ""))
    exponent = F.coalesce(F.regexp_extract(text, r"e([-+]?\d+)", 1).try_cast("int"), F.lit(0))
    return F.greatest(fraction - exponent, F.lit(0))


def head_precision(df: DataFrame, keys: list[str], index: str = "bar_idx") -> DataFrame:
    places = F.greatest(*[F.coalesce(decimals(F.col(c)), F.lit(0)) for c in ("open", "high", "low", "close")])
    return df.where(F.col(index) < HEAD_ROWS).groupBy(*keys).agg(F.max(places).alias("decimals"))


def swap_checks(df: DataFrame, keys: list[str]) -> DataFrame:
    """Whether high and low bound open and close often enough, and if not, which column took their place.

    ``verdict`` is ``ok`` (or too few rows to tell), ``open_low_swapped``, ``open_high_swapped`` or ``unclear``.
    """
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    share = lambda cond: F.avg(F.coalesce(cond, F.lit(False)).cast("double"))
    h, lo = F.col("high"), F.col("low")
    r = df.groupBy(*keys).agg(
        F.count("*").alias("n"), share(h >= top - EPSILON).alias("high_ok"), share(lo <= bottom + EPSILON).alias("low_ok"), share(lo >= top - EPSILON).alias("low_above"), share(h <= bottom + EPSILON).alias("high_below")
    )
    fine = (F.col("n") <= 10) | ((F.col("high_ok") >= 0.9) & (F.col("low_ok") >= 0.9))
    return r.withColumn("verdict", F.when(fine, "ok").when(F.col("low_above") > 0.5, "open_low_swapped").when(F.col("high_below") > 0.5, "open_high_swapped").otherwise("unclear"))


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; aggregated on the map side, so repeated keys are no skew."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def layout_vote(lines: DataFrame, keys: list[str], line: str = "line", sep: str = "tab_or_comma") -> DataFrame:
    """Whether a file holds date and time in two columns: over 80 % of its rows start with eight and six to nine digits."""
    parts = F.split(F.col(line), "[,\t]")
    two = F.coalesce(F.trim(F.get(parts, F.lit(0))).rlike(r"^\d{8}$") & F.trim(F.get(parts, F.lit(1))).rlike(r"^\d{6,9}$"), F.lit(False))
    r = lines.groupBy(*keys).agg(F.avg(two.cast("double")).alias("share"), F.max(F.size(parts)).alias("columns"))
    return r.withColumn("layout", F.when((F.col("share") > 0.8) & (F.col("columns") >= 5), "ticks_5col").otherwise("ticks_4col"))


def first_line_delimiter(lines: DataFrame, keys: list[str], line: str = "line", order: str = "line_no") -> DataFrame:
    """Tab if the first line has three tabs or more, else comma."""
    head = F.min_by(line, order)
    r = lines.where(F.col(line).isNotNull()).groupBy(*keys).agg(head.alias("head"))
    tabs = F.length("head") - F.length(F.replace(F.col("head"), F.lit("\t"), F.lit("")))
    return r.select(*keys, F.when(tabs >= 3, "tab").otherwise("comma").alias("delimiter"))


def infer_symbol(name: Column) -> Column:
    """Symbol in a file name: the first three of its first six capitals, else the first known name in it, else UNK."""
    upper = F.upper(name)
    # fixed values
    known = "XAG|XAU|BTC|ETH|EUR|GBP|JPY|AUD|CAD|CHF|NZD"
    six, named = F.regexp_extract(upper, "([A-Z]{6})", 1), F.regexp_extract(upper, f"({known})", 1)
    return F.when(six != "", F.substring(six, 1, 3)).when(named != "", named).otherwise("UNK")

"""Timestamp texts of mixed shape and zone, brought to one UTC instant (problem 6).

Every text is read under each form that fits it: a slashed date as month first or day first, a count of digits in any unit
that gives a date. Expectation-maximisation over the mixture of readings in each source settles which are meant; a
declared date order is a strong but finite prior. Readings whose posterior is not near certain are marked. Zone-less
readings are placed with the source's zone, and those the zone skips or has twice stay unresolved rather than being guessed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timetext as T
from ..scale import lookup_join
from ..session import materialize

#: A reading is taken only if its posterior reaches this; else the row is marked ``ambiguous``.
CERTAIN = 0.999
EM_ROUNDS, EM_TOLERANCE = 200, 1e-9
#: Prior of the orders that a source's declared one is not, and of both orders where none is declared; the share of slips
#: that an order can explain, and the least share of each order in a source that writes both.
OTHER_ORDER, MIXED, SLIPS, BOTH = 1e-6, 0.01, 0.05, 0.25
#: Decades that texts are likely to be of, and how much less likely others are, whatever else a source holds.
DECADES, UNLIKELY = range(199, 204), 1e-4
UNITS = ["s", "ms", "us", "ns"]
#: Digits of a count of the present in each unit.
DIGITS = [10, 13, 16, 19]
_DECADE_US = 315_569_520 * T.US

_EM_SCHEMA = "source long, declared string, p_mdy double, p_dmy double, p_mixed double, share_mdy double, units map<int,int>, weights map<string,double>"


def date_orders(only_mdy: float, only_dmy: float, declared: str | None) -> tuple[np.ndarray, float]:
    """Posterior of a source writing month first, day first or both, and the share of month first if both.

    ``only_mdy`` and ``only_dmy`` count the texts that only one order can read. Either order explains up to SLIPS of the
    texts as slips, and a source that writes both has at least BOTH of each.
    """
    prior = {"mdy": [1 - 2 * OTHER_ORDER, OTHER_ORDER, OTHER_ORDER], "dmy": [OTHER_ORDER, 1 - 2 * OTHER_ORDER, OTHER_ORDER]}.get(declared, [(1 - MIXED) / 2, (1 - MIXED) / 2, MIXED])
    n = only_mdy + only_dmy
    share = only_mdy / n if n else 0.5
    slips = [np.clip(x, 1e-4, SLIPS) for x in (1 - share, share)]
    both = float(np.clip(share, BOTH, 1 - BOTH))
    like = [only_mdy * np.log(1 - slips[0]) + only_dmy * np.log(slips[0]), only_dmy * np.log(1 - slips[1]) + only_mdy * np.log(slips[1]), only_mdy * np.log(both) + only_dmy * np.log(1 - both)]
    score = np.log(prior) + np.array(like)
    p = np.exp(score - score.max())
    return p / p.sum(), both


def mixture(pdf: pd.DataFrame) -> tuple[dict[str, float], dict[int, dict[str, float]]]:
    """Weights of the readings in one source, and the posterior of each unit for each kind of count.

    Rows are kinds of texts: ``form, ok_mdy, ok_dmy, key, decade, n``. A text's likelihood under a reading is the weight of
    the reading times that of the decade it leads to in this source, which are fitted, times what is known of that decade.
    """
    names = [f for f in T.FORMS if f not in ("epoch", "slashed")] + ["mdy", "dmy", *UNITS]
    ways: list[list[tuple[int, int]]] = []
    for form, m, d, key, decade in zip(pdf["form"], pdf["ok_mdy"], pdf["ok_dmy"], pdf["key"], pdf["decade"]):
        form = T.FORMS[int(form)]
        if form == "epoch":
            usual = DIGITS.index(int(key) // 1000)
            # a finer unit brings the same digits to the seventies
            ways.append([(names.index(u), int(key) % 1000 if i == usual else 197) for i, u in enumerate(UNITS) if i >= usual])
        elif form == "slashed":
            ways.append([(names.index(x), int(decade)) for x, ok in (("mdy", m), ("dmy", d)) if ok])
        else:
            ways.append([(names.index(form), int(decade))])
    n = pdf["n"].to_numpy(float)
    row = np.array([i for i, w in enumerate(ways) for _ in w], int)
    part, decade = (np.array([x[k] for w in ways for x in w], int) for k in (0, 1))
    seen, at = np.unique(decade, return_inverse=True)
    before = np.where(np.isin(seen, list(DECADES)), 1.0, UNLIKELY)
    weight, time = np.full(len(names), 1 / len(names)), np.full(len(seen), 1 / len(seen))
    share = np.zeros(len(row))
    for _ in range(EM_ROUNDS):
        joint = weight[part] * (time * before)[at]
        share = joint / np.maximum(np.bincount(row, joint, len(ways))[row], 1e-300)
        count = share * n[row]
        new = np.bincount(part, count, len(names)) / n.sum()
        time = np.bincount(at, count, len(seen)) / n.sum()
        moved, weight = np.abs(new - weight).max(), new
        if moved < EM_TOLERANCE:
            break
    posterior: dict[int, dict[str, float]] = {}
    for r, k, p in zip(row, part, share):
        if names[k] in UNITS:
            posterior.setdefault(int(pdf["key"].iloc[r]), {})[names[k]] = float(p)
    return dict(zip(names, weight.tolist())), posterior


def _em(pdf: pd.DataFrame) -> pd.DataFrame:
    declared = pdf["declared"].iloc[0]
    slashed = pdf[pdf["form"] == T.FORMS.index("slashed")]
    count = lambda m, d: float(slashed.loc[(slashed["ok_mdy"] == m) & (slashed["ok_dmy"] == d), "n"].sum())
    order, share = date_orders(count(1, 0), count(0, 1), declared)
    weights, posterior = mixture(pdf)
    units = {key: max((UNITS.index(u) for u, q in p.items() if q >= CERTAIN), default=-1) for key, p in posterior.items()}
    return pd.DataFrame({"source": [pdf["source"].iloc[0]], "declared": [declared], "p_mdy": [order[0]], "p_dmy": [order[1]], "p_mixed": [order[2]], "share_mdy": [share], "units": [units], "weights": [weights]})


def read_forms(df: DataFrame, row_id: str, text: str, source: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Parse each text under its forms.

    Columns: row_id, source, ``keep``, kind (0 unreadable, 1 own zone, 2 zone-less, 3 zone abbreviation), ``form``,
    ``a_us`` (the only reading, or month first if slashed), ``b_us`` (day first), ``off_us``, ``abbr``, and for counts
    ``count`` and ``key`` (1000 times the digits plus the decade in the unit that has so many digits today).
    """
    raw = df.select(F.col(row_id).alias("row_id"), F.col(source).cast("long").alias("source"), *[F.col(k).alias(f"k_{k}") for k in keep], T.trimmed(F.col(text)).alias("_s"))
    x = raw.withColumn("_f", T.form_of(F.col("_s")))
    s, form = F.col("_s"), F.col("_f")
    worded = form.isin(1, 3, 4)
    kept = ["row_id", "source", *[f"k_{k}" for k in keep]]
    tail = r":\d{2}[.,\d]*(?: ?[AaPp][Mm])? *(?:[A-Z]+|[+-]\d{2}:?\d{2})?$"
    x = x.select(
        *kept, "_s", _apart(form).alias("_f"),
        F.when(worded, F.regexp_extract(s, r"\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?", 0)).alias("_time"),
        F.when(worded, F.regexp_extract(s, tail, 0)).otherwise(F.lit("")).alias("_tail"),
        F.when(form.isin(1, 3), F.regexp_extract(s, r"^[0-9/-]+", 0)).when(form == 4, F.regexp_extract(s, r"^\d+[ -][A-Za-z]+[ -]\d+", 0)).when(form == 0, F.rpad(F.when(F.length(s) == 8, F.concat(s, F.lit(" 000000"))).otherwise(s), 18, "0")).alias("_date"),
    )
    form, s, date = F.col("_f"), F.col("_s"), F.col("_date")
    named = F.split(date, "[ -]")
    x = x.select(
        *kept, _apart(form).alias("_f"), "_time", "_tail",
        F.when(form == 2, s).alias("_digits"),
        F.when(form == 0, F.regexp_replace(date, r"^(\d{4})(\d\d)(\d\d) (\d\d)(\d\d)(\d\d)(\d{3})$", "$1-$2-$3 $4:$5:$6.$7")).when(form == 3, F.regexp_replace(date, r"^(\d+)/(\d+)/(\d+)$", "$3-$1-$2"))
        .when(form == 4, F.concat_ws("-", F.get(named, F.lit(2)), T.month_number(F.get(named, F.lit(1))).cast("string"), F.get(named, F.lit(0)))).otherwise(date).alias("_one"),
        F.when(form == 3, F.regexp_replace(date, r"^(\d+)/(\d+)/(\d+)$", "$3-$2-$1")).alias("_two"),
        F.when(worded, F.concat(F.lit(" "), F.when(F.col("_time") == "", "00:00:00").otherwise(F.regexp_replace(F.translate("_time", ",", "."), r"^(\d+:\d+)$", "$1:00")))).otherwise(F.lit("")).alias("_clock"),
    )
    tail, form = F.col("_tail"), F.col("_f")
    half = F.when(form == 3, F.upper(F.regexp_extract(tail, r"([AaPp])[Mm]", 1))).otherwise(F.lit(""))
    zone = F.when(tail != "", F.regexp_replace(tail, r"^:\d{2}[.,\d]*(?: ?[AaPp][Mm])? *", "")).otherwise(F.lit(""))
    hour = F.substring_index(F.when(form == 3, F.col("_time")), ":", 1)
    x = x.select(*kept, _apart(form).alias("_f"), "_digits", F.concat("_one", "_clock").alias("_one"), F.concat("_two", "_clock").alias("_two"), half.alias("_half"), hour.alias("_hour"), zone.alias("_zone"))
    # (casts see nulls instead of other texts, as a failing cast costs as much as all the rest)
    n, count = F.length("_digits"), F.col("_digits").try_cast("long")
    usual_us = F.when(n == 10, count * T.US).when(n == 13, count * 1000).when(n == 16, count).otherwise(F.floor(count / 1000))
    key = (n * 1000 + F.floor(usual_us / _DECADE_US) + 197).cast("int")
    # twelve-hour clocks: 12 AM is midnight, 12 PM noon, and 0 or 13 to 23 with AM or PM name no time
    h = F.when(F.col("_half") != "", F.col("_hour")).try_cast("int")
    noon = 12 * 3600 * T.US
    shift = F.when(F.col("_half") == "", F.lit(0)).when((h < 1) | (h > 12), F.lit(None)).when((F.col("_half") == "P") & (h < 12), F.lit(noon)).when((F.col("_half") == "A") & (h == 12), F.lit(-noon)).otherwise(F.lit(0))
    x = x.select(*kept, _apart(F.col("_f")).alias("_f"), "_zone", count.alias("_count"), F.when(count.isNotNull(), key).alias("_key"), T.instant_us(F.col("_one")).alias("_a"), T.instant_us(F.col("_two")).alias("_b"), shift.cast("long").alias("_shift"))
    form, zone = F.col("_f"), F.col("_zone")
    utc = zone.isin("Z", "UTC", "GMT", "UT")
    offset = F.when(utc | (form == 2), F.lit(0).cast("long")).otherwise(T.offset_us(F.when(zone.rlike(r"^[+-]"), zone)))
    x = x.select(
        *kept, form.alias("form"), F.when(form == 3, F.col("_a") + F.col("_shift")).otherwise(F.col("_a")).alias("a_us"), (F.col("_b") + F.col("_shift")).alias("b_us"),
        offset.alias("off_us"), F.when(zone.rlike(r"^[A-Z]") & ~utc, zone).alias("abbr"), (zone == "").alias("_bare"), F.col("_count").alias("count"), F.col("_key").alias("key"),
    )
    kind = F.when(F.coalesce("a_us", "b_us", "count").isNull(), 0).when(F.col("off_us").isNotNull(), 1).when(F.col("abbr").isNotNull(), 3).when(F.col("_bare"), 2).otherwise(0)
    return x.select(*kept, kind.alias("kind"), "form", "a_us", "b_us", "off_us", "abbr", "count", "key")


def _apart(c: Column) -> Column:
    """The column itself, by way of a higher-order function, which keeps its projection out of whole-stage code.

    All projections of the reader in one generated method are more than the 8 KB of byte code up to which the JVM
    compiles a method; interpreted, they take three times as long.
    """
    return F.get(F.transform(F.array(c), lambda v: v), F.lit(0))


def normalise_timestamps(
    df: DataFrame,
    feeds: DataFrame,
    row_id: str,
    text: str,
    source: str = "feed_id",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One UTC instant per text, or the reason why it has none.

    ``feeds`` has ``source, tz_name, date_style``, one row per source (a repeated source takes one of its rows).
    Result, a row per input row: ``row_id, source, <keep>, utc_us, status`` with status ``ok``, ``unreadable``
    (null, blank, no known form or an impossible date), ``no_zone``, ``unknown_abbreviation``, ``skipped``, ``twice``
    or ``ambiguous``. An empty input gives an empty result; columns that are not named are ignored, so their names
    cannot clash.
    """
    spark = df.sparkSession
    parsed = materialize(read_forms(df, row_id, text, source, keep), "parsed")
    styles = feeds.groupBy(F.col(source).cast("long").alias("source")).agg(F.first("date_style", True).alias("declared"), F.first("tz_name", True).alias("tz_name"))

    decade = (F.floor(F.coalesce("a_us", "b_us") / _DECADE_US) + 197).cast("int")
    is_slashed = F.coalesce(F.col("form") == 3, F.lit(False))
    flag = lambda c: F.when(is_slashed, F.col(c).isNotNull().cast("int")).otherwise(0)
    kinds = parsed.where("kind <> 0").groupBy("source", "form", flag("a_us").alias("ok_mdy"), flag("b_us").alias("ok_dmy"), "key", decade.alias("decade")).agg(F.count("*").alias("n"))
    mixtures = kinds.join(styles.select("source", "declared"), "source", "left").groupBy("source").applyInPandas(_em, _EM_SCHEMA)

    # zones: the distinct names are few (there are some 600 regions); their abbreviations are tabulated once
    known = F.col("tz_name").isin(T.regions()) | F.upper(F.trim("tz_name")).isin("Z", "UTC", "GMT") | F.trim("tz_name").rlike(r"^[+-]\d\d:\d\d$")
    names = [r[0] for r in styles.where(known).select("tz_name").distinct().collect() if T.is_zone(r[0])]
    rows = []
    for z in names:
        fixed = T.fixed_offset(z)
        rows.append((z, z if fixed is None else None, None if fixed is None else int(fixed.total_seconds()) * T.US, T.zone_abbreviations(z)))
    zones = spark.createDataFrame(rows, "tz_name string, region string, fixed_us long, abbreviations map<string,array<struct<from:long,to:long,off:long>>>")
    first, both = F.coalesce("p_mdy", F.lit(0.0)), F.coalesce("p_mixed", F.lit(1.0))
    # texts that both orders read go by the posterior, those of the other order alone are no dates of a source that is sure of its own
    month = first + both * F.coalesce("share_mdy", F.lit(0.5))
    pick = F.when(month >= CERTAIN, "m").when(month <= 1 - CERTAIN, "d").otherwise("?")
    sure = F.when(first >= CERTAIN, "m").when(F.coalesce("p_dmy", F.lit(0.0)) >= CERTAIN, "d").otherwise("?")
    settled = styles.join(F.broadcast(zones), "tz_name", "left").join(mixtures.drop("declared"), "source", "left").select("source", "region", "fixed_us", "abbreviations", pick.alias("pick"), sure.alias("sure"), "units")
    # texts without a source are a source of their own, without zone
    x = lookup_join(parsed, materialize(settled, "sources"), ["source"])

    mdy, dmy, pick, sure = F.col("a_us"), F.col("b_us"), F.coalesce(F.col("pick"), F.lit("?")), F.coalesce(F.col("sure"), F.lit("?"))
    slashed_us = F.when(mdy.isNull(), dmy).when(dmy.isNull() | (mdy == dmy) | (pick == "m"), mdy).when(pick == "d", dmy)
    impossible = ((sure == "m") & mdy.isNull() | (sure == "d") & dmy.isNull()) & is_slashed
    # a source that is not known has the unit of its digits
    number, digits = F.col("count"), F.floor(F.col("key") / 1000)
    usual = F.when(digits == 10, 0).when(digits == 13, 1).when(digits == 16, 2).otherwise(3)
    unit = F.when(F.col("units").isNull(), usual).otherwise(F.try_element_at("units", F.col("key")))
    count_us = F.when(unit == 0, number * T.US).when(unit == 1, number * 1000).when(unit == 2, number).when(unit == 3, F.floor(number / 1000))
    kind = F.col("kind")
    # a feed with a fixed offset has one zone, so its abbreviation can only be that
    # an abbreviation of several offsets is decided by the date
    stretches = F.filter(F.try_element_at("abbreviations", F.col("abbr")), lambda s: (s["from"] <= mdy) & (mdy < s["to"]))
    offsets = F.array_distinct(F.transform(stretches, lambda s: s["off"]))
    meant = F.when(F.size(offsets) == 1, F.get(offsets, F.lit(0)))
    offset = F.when(kind == 1, F.col("off_us")).when(kind == 3, F.coalesce(meant, F.col("fixed_us"))).when(kind == 2, F.col("fixed_us"))
    x = x.select("row_id", "source", *[f"k_{k}" for k in keep], F.when(impossible, 0).otherwise(kind).alias("kind"), F.when(F.col("key").isNotNull(), count_us).when(is_slashed, slashed_us).otherwise(mdy).alias("_local"), offset.alias("_off"), "region")
    x = x.withColumn("_reg", F.when((F.col("kind") == 2) & F.col("_off").isNull() & F.col("region").isNotNull(), F.col("_local")))
    x = T.with_local_to_utc(x, "_reg", "region")
    kind, n = F.col("kind"), F.col("_n")
    status = (
        F.when(kind == 0, "unreadable")
        .when(F.col("_local").isNull(), "ambiguous")
        .when(F.col("_off").isNotNull(), "ok")
        .when(kind == 3, "unknown_abbreviation")
        .when(F.col("region").isNull(), "no_zone")
        .when(n == 0, "skipped")
        .when(n == 2, "twice")
        .otherwise("ok")
    )
    utc = F.when(kind == 0, F.lit(None)).otherwise(F.coalesce(F.col("_local") - F.col("_off"), F.when(n == 1, F.col("_utc"))))
    return x.select("row_id", "source", *[F.col(f"k_{k}").alias(k) for k in keep], utc.alias("utc_us"), status.alias("status"))

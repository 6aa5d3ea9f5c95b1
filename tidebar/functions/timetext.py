"""Column expressions that read timestamp texts; everything stays inside generated JVM code."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

US = 1_000_000

#: Forms a text may have, by number.
FORMS = ["compact", "iso", "epoch", "slashed", "named"]
_TIME = r"\d{1,2}:\d{2}(:\d{2}([.,]\d{1,9})?)?"
_PATTERNS = {
    "compact": r"^\d{8}( (\d{6}|\d{9}))?$",
    "iso": rf"^\d{{4}}-\d{{1,2}}-\d{{1,2}}([T ]{_TIME}( ?(Z|[+-]\d{{2}}:?\d{{2}}| [A-Z]{{2,5}}))?)?$",
    "epoch": r"^(\d{10}|\d{13}|\d{16}|\d{19})$",
    "slashed": rf"^\d{{1,2}}/\d{{1,2}}/\d{{4}}( {_TIME}( ?[AaPp][Mm])?( (Z|[A-Z]{{3,5}}|[+-]\d{{2}}:?\d{{2}}))?)?$",
    "named": rf"^\d{{1,2}}[ -][A-Za-z]{{3,9}}[ -]\d{{4}}( {_TIME}( ?(Z|[+-]\d{{2}}:?\d{{2}}|[A-Z]{{2,5}}))?)?$",
}
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def trimmed(c: Column) -> Column:
    return F.trim(c, F.lit(" \t\r\n"))


def form_of(s: Column) -> Column:
    """Number of the first form whose pattern fits, null if none does."""
    out = F.when(s.rlike(_PATTERNS["compact"]), F.lit(0))
    for i, f in enumerate(FORMS[1:], 1):
        out = out.when(s.rlike(_PATTERNS[f]), F.lit(i))
    return out


def instant_us(text: Column) -> Column:
    """Microseconds since the epoch of ``y-m-d h:m[:s[.f]]`` read as UTC; null if any part is out of its range."""
    return F.unix_micros(F.concat(text, F.lit("Z")).try_cast("timestamp"))


def offset_us(text: Column) -> Column:
    """``+HH:MM`` or ``+HHMM`` as microseconds; null if out of range (beyond 18 hours)."""
    digits = F.regexp_replace(text, r"[^0-9]", "")
    hours, minutes = F.substring(digits, 1, 2).try_cast("long"), F.substring(digits, 3, 2).try_cast("long")
    sign = F.when(text.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    return F.when((minutes <= 59) & (hours <= 18), sign * (hours * 60 + minutes) * 60 * US)


def month_number(name: Column) -> Column:
    low = F.lower(F.substring(name, 1, 3))
    return F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), low)


def is_zone(name: str | None) -> bool:
    """Whether a zone name is a region or a fixed offset that both Java and Python read alike."""
    if name is None:
        return False
    return bool(fixed_offset(name) is not None or name in available_timezones())


def fixed_offset(name: str) -> timedelta | None:
    text = name.strip()
    if text.upper() in ("Z", "UTC", "GMT"):
        return timedelta(0)
    if len(text) == 6 and text[0] in "+-" and text[3] == ":" and (text[1:3] + text[4:]).isdigit():
        at = timedelta(hours=int(text[1:3]), minutes=int(text[4:]))
        return (-at if text[0] == "-" else at) if at <= timedelta(hours=18) else None
    return None


def regions() -> list[str]:
    """Names of all regions known here (some 600)."""
    return sorted(available_timezones())


def zone_abbreviations(name: str) -> dict[str, list[tuple[int, int, int]]]:
    """Abbreviations of a region over its whole history: (from, to, offset) in microseconds, the ends as wall-clock readings.

    A reading carries an abbreviation's offset if it lies in one of its stretches. An abbreviation that always meant the
    same offset has one stretch without ends, so it may be written at any time of the year.
    """
    if fixed_offset(name) is not None:
        return {}
    zone, out = ZoneInfo(name), {}
    day = timedelta(days=1)
    at, last = datetime(1850, 1, 1, tzinfo=timezone.utc), datetime(2100, 1, 1, tzinfo=timezone.utc)
    shown = lambda t: (t.astimezone(zone).tzname(), t.astimezone(zone).utcoffset())
    begin, state = None, shown(at)
    while at < last:
        step = min(at + 7 * day, last)
        if shown(step) != state or step == last:
            lo, hi = at, step
            while shown(hi) != state and hi - lo > timedelta(seconds=1):
                mid = lo + (hi - lo) / 2
                lo, hi = (mid, hi) if shown(mid) == state else (lo, mid)
            name_, offset = state
            change = hi.replace(microsecond=0) if shown(hi) != state else None
            us = int(offset.total_seconds()) * US
            end = None if change is None else int(change.timestamp()) * US + us
            if name_ and name_.isalpha():
                out.setdefault(name_, []).append((-(2**62) if begin is None else begin + us, 2**62 if end is None else end, us))
            if change is None:
                break
            begin, state, at = int(change.timestamp()) * US, shown(hi), hi
        else:
            at = step
    return {k: v if len({x[2] for x in v}) > 1 else [(-(2**62), 2**62, v[0][2])] for k, v in out.items()}


def with_local_to_utc(df: DataFrame, local_us: str, zone: str) -> DataFrame:
    """Add ``_n``, the number of instants a wall-clock reading names in its zone (0 in a gap, 2 in an overlap), and ``_utc``.

    The offsets in force 26 hours before and after bracket any single transition; where they differ, an instant
    counts if the zone shows the reading at it. Rows with a null reading get nulls.
    """
    local, name, margin = F.col(local_us), F.col(zone), 26 * 3600 * US

    def shown(us: Column) -> Column:
        return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), name))

    df = df.withColumns({"_a": local - (shown(local - margin) - (local - margin)), "_b": local - (shown(local + margin) - (local + margin))})
    a, b = F.col("_a"), F.col("_b")
    df = df.withColumn("_a_ok", F.when(a == b, F.lit(True)).otherwise(shown(a) == local))
    n = F.when(a == b, 1).otherwise(F.col("_a_ok").cast("int") + (shown(b) == local).cast("int"))
    return df.withColumns({"_n": n, "_utc": F.when(F.col("_a_ok"), a).otherwise(b)})

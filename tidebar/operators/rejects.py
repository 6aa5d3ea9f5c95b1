"""Raw delimited lines split into typed rows and reasoned rejects (problem 1).

Each Arrow batch of lines is read as one byte buffer. Numpy masks of quote bytes and their running parity tell which
delimiters and record ends stand outside quotes; fields are byte ranges between those, and the checks on quoting,
column count and values run on all ranges of the batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import lookup_join
from ..session import materialize

REASONS = ["quoting", "columns", "bid", "ask", "vol"]
_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_SCHEMA = "line_id long, file_id long, dt string, bid double, ask double, vol double, reason string"
QUOTE, NEWLINE = 34, 10


def structural_index(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the delimiters outside quotes, the record each belongs to, and the records whose quotes do not close.

    ``data`` holds the bytes of all records, record i being ``data[starts[i]:ends[i]]``. The parity of the quotes seen
    since a record's start decides what lies inside quotes, so records cannot affect each other.
    """
    quotes = np.cumsum(data == QUOTE, dtype=np.int64)
    before = np.concatenate([[0], quotes])
    unclosed = ((before[ends] - before[starts]) & 1).astype(bool)
    at = np.flatnonzero(data == sep)
    record = np.searchsorted(starts, at, "right") - 1
    within = (record >= 0) & (at < ends[np.maximum(record, 0)])
    at, record = at[within], record[within]
    outside = ((before[at] - before[starts[record]]) & 1) == 0
    return at[outside], record[outside], unclosed


def _ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, blanks: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges without the blanks at their ends."""
    a, b = starts.copy(), ends.copy()
    padded = np.append(data, 0)
    blank = np.isin(padded, blanks)
    while (move := (a < b) & blank[np.minimum(a, len(data))]).any():
        a[move] += 1
    while (move := (a < b) & blank[np.maximum(b - 1, 0)]).any():
        b[move] -= 1
    return a, b


def _take(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Array:
    """Strings of byte ranges."""
    lengths = b - a
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    index = np.repeat(a - offsets[:-1], lengths) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(a), pa.py_buffer(offsets), pa.py_buffer(data[index].tobytes()))


def check_lines(lines: pa.Array, sep: int) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Reason (index into REASONS, -1 for a valid tick) and the four typed fields of each line under one separator."""
    lines = pc.fill_null(lines.cast(pa.large_string()), "")
    if isinstance(lines, pa.ChunkedArray):
        lines = lines.combine_chunks()
    n = len(lines)
    offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + n + 1]
    buffer = lines.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    starts, ends = offsets[:-1].copy(), offsets[1:].copy()
    # a line end kept by the sender (LF, CR LF) is no content
    starts0 = starts
    _, ends = _ranges(data, starts, ends, (10, 13))
    ends = np.maximum(ends, starts0)
    at, record, unclosed = structural_index(data, starts, ends, sep)
    reason = np.full(n, -1, np.int8)

    commas = np.bincount(record, minlength=n)
    # all fields of all records: every record start and every delimiter begins one
    begin = np.concatenate([starts, at + 1])
    owner = np.concatenate([np.arange(n), record])
    order = np.lexsort((begin, owner))
    begin, owner = begin[order], owner[order]
    last = np.append(owner[1:] != owner[:-1], True) if n else np.zeros(0, bool)
    finish = np.where(last, ends[owner], np.append(begin[1:] - 1, 0)) if n else begin
    blanks = (32,) if sep == 9 else (32, 9)
    a, b = _ranges(data, begin, finish, blanks)
    before = np.concatenate([[0], np.cumsum(data == QUOTE, dtype=np.int64)])
    held = before[b] - before[a]
    safe = np.append(data, 0)
    whole = (b - a >= 2) & (safe[np.minimum(a, len(data))] == QUOTE) & (safe[np.maximum(b - 1, 0)] == QUOTE)
    # quoted as a whole: first and last byte are quotes and what lies between holds none
    broken = np.where(whole, held != 2, held != 0)
    bad_quote = unclosed | (np.bincount(owner, weights=broken, minlength=n) > 0)
    reason[bad_quote] = 0
    reason[(reason < 0) & (commas != 3)] = 1
    good = np.flatnonzero(reason < 0)
    first = np.searchsorted(owner, good)
    texts: list[pa.Array] = []
    for k in range(4):
        f = first + k
        x, y = a[f] + whole[f], b[f] - whole[f]
        x, y = _ranges(data, x, y, blanks)
        texts.append(_take(data, x, y))
    typed: list[pa.Array] = [texts[0]]
    for k in (1, 2, 3):
        text = texts[k]
        numeric = pc.match_substring_regex(text, _NUMBER)
        value = pc.cast(pc.if_else(numeric, pc.replace_substring_regex(text, r"^\+", ""), None), pa.float64())
        v = value.to_numpy(zero_copy_only=False)
        if k < 3:
            wrong = ~(np.isfinite(v) & (v > 0))
        else:
            empty = pc.equal(text, "").to_numpy(zero_copy_only=False)
            wrong = ~(empty | (np.isfinite(v) & (v >= 0)))
        hit = good[wrong]
        reason[hit[reason[hit] < 0]] = k + 1
        typed.append(value)
    spread = np.full(n, -1)
    spread[good] = np.arange(len(good))
    ok = reason < 0
    where = pa.array(np.where(ok, spread, 0), mask=~ok)
    fields = {c: pc.take(t, where) if len(t) else pa.nulls(n, t.type) for c, t in zip(("dt", "bid", "ask", "vol"), typed)}
    return reason, fields


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    labels = pa.array(REASONS)
    for batch in batches:
        tab = batch["tab"].to_numpy(zero_copy_only=False).astype(bool)
        for is_tab in (False, True):
            part = batch.filter(pa.array(tab == is_tab))
            if not part.num_rows:
                continue
            reason, f = check_lines(part["line"], 9 if is_tab else 44)
            wrong = reason >= 0
            yield pa.RecordBatch.from_arrays(
                [part["line_id"], part["file_id"], f["dt"].cast(pa.string()), f["bid"], f["ask"], f["vol"], pc.take(labels, pa.array(np.maximum(reason, 0), mask=~wrong))],
                names=["line_id", "file_id", "dt", "bid", "ask", "vol", "reason"],
            )


def load_tick_lines(lines: DataFrame) -> DataFrame:
    """Typed ticks and rejects of raw ``dt,bid,ask,vol`` lines, one row per input row.

    Input columns: ``line_id, file_id, line``; others are ignored. A file's separator (comma or tab) is the one that
    gives more of its lines three delimiters, a comma on a tie. Valid rows have a null ``reason`` and their values,
    rejects have nulls and the first of ``quoting, columns, bid, ask, vol`` that applies. A null or empty line has one
    field and is rejected for ``columns``; repeated lines each give a row; an empty table gives an empty result; text
    length is not limited.
    """
    x = lines.select(F.col("line_id").cast("long").alias("line_id"), F.col("file_id").cast("long").alias("file_id"), F.col("line").cast("string").alias("line"))
    line = F.coalesce(F.col("line"), F.lit(""))
    has = lambda c: F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))
    votes = x.groupBy("file_id").agg(F.sum((has("\t") == 3).cast("long")).alias("_t"), F.sum((has(",") == 3).cast("long")).alias("_c"))
    tabs = materialize(votes.where("_t > _c").select("file_id", F.lit(True).alias("tab")), "tabs")
    marked = lookup_join(x, tabs, ["file_id"]).select("line_id", "file_id", F.coalesce("tab", F.lit(False)).alias("tab"), "line")
    return marked.mapInArrow(_load, _SCHEMA)

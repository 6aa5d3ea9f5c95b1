"""Delivered files whose columns drift, read into one table with every change reported (problem 2).

A file's schema is a tree: the root's children are its columns, and dots in a name nest further. The cheapest script of
adds, deletes, renames, type changes and moves between the trees of two neighbouring files of a stream reports the
changes; the scripts, chained from a stream's first file on, give each file the projection onto the stream's columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import by_group, lookup_join
from ..session import materialize

SEPARATORS = [",", ";", "\t"]
TYPES = ["integer", "decimal", "boolean", "timestamp", "text"]
#: Costs of the edit script. A rename must be cheaper than a delete with an add, and keeps the kind of content.
ADD, DELETE, RENAME, RETYPE, MOVE = 1.0, 1.0, 1.0, 0.4, 1.0
OTHER_CONTENT = 5.0

_INTEGER = r"^[+-]?[0-9]+$"
_DECIMAL = r"^[+-]?([0-9]+[.][0-9]*|[.][0-9]+|[0-9]+[eE][+-]?[0-9]+)([eE][+-]?[0-9]+)?$"
_STAMP = r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([T ].*)?|[0-9]{8} [0-9]{6,9}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}( .*)?|[0-9]{1,2}[ -][A-Za-z]{3}[ -][0-9]{4}( .*)?)$"


def value_type(v):
    """Number of a trimmed cell's type in TYPES, null for an empty cell."""
    return (
        F.when(v == "", F.lit(None))
        .when(v.rlike(_INTEGER), 0)
        .when(v.rlike(_DECIMAL), 1)
        .when(F.lower(v).isin("true", "false"), 2)
        .when(v.rlike(_STAMP), 3)
        .otherwise(4)
    )


def _cells(line, sep):
    """Cells of a line; quotes around a whole cell are taken off."""
    parts = F.when(sep == ",", F.split(line, ",")).when(sep == ";", F.split(line, ";")).otherwise(F.split(line, "\t"))
    bare = lambda c: F.when(c.startswith('"') & c.endswith('"') & (F.length(c) > 1), c.substr(F.lit(2), F.length(c) - 2)).otherwise(c)
    return F.transform(parts, lambda c: bare(F.trim(c, F.lit(" \t\r\n"))))


# --- edit scripts -------------------------------------------------------------------------------------------------


def tree(columns: list[tuple[str, str | None]]) -> dict:
    """Nested schema of (dotted name, type) leaves: name -> type or subtree."""
    root: dict = {}
    for name, kind in columns:
        node, *rest = name.split(".")
        if rest:
            child = root.setdefault(node, {})
            if not isinstance(child, dict):
                child = root[node] = {}
            child.update(tree([(".".join(rest), kind)]) | {k: v for k, v in child.items() if k != rest[0]})
        else:
            root.setdefault(node, kind)
    return root


def _kind(node) -> str | None:
    return "struct" if isinstance(node, dict) else node


def _size(node) -> int:
    return 1 + sum(_size(c) for c in node.values()) if isinstance(node, dict) else 1


def _likeness(a: str, b: str) -> float:
    """Share of common letter pairs of two names, only to break ties between equally good renames."""
    x, y = ({n[i : i + 2] for i in range(len(n) - 1)} | {n[:1]} for n in (a, b))
    return 2 * len(x & y) / max(1, len(x) + len(y))


def assign(costs: np.ndarray) -> list[int]:
    """Column of each row in the assignment of least total cost (Hungarian algorithm); there are at least as many columns as rows."""
    rows, columns = costs.shape
    u, v = np.zeros(rows + 1), np.zeros(columns + 1)
    owner, way = np.zeros(columns + 1, int), np.zeros(columns + 1, int)
    for i in range(1, rows + 1):
        owner[0], at = i, 0
        least, used = np.full(columns + 1, np.inf), np.zeros(columns + 1, bool)
        while True:
            used[at] = True
            slack = np.concatenate([[np.inf], costs[owner[at] - 1] - u[owner[at]] - v[1:]])
            better = ~used & (slack < least)
            least[better], way[better] = slack[better], at
            free = np.where(used, np.inf, least)
            at = int(free.argmin())
            step = free[at]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            if not owner[at]:
                break
        while at:
            owner[at] = owner[way[at]]
            at = int(way[at])
    out = [0] * rows
    for j in range(1, columns + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def _script(old: dict, new: dict, path: str = "") -> tuple[float, list[tuple[str, str, str]]]:
    """Script between two trees whose fields stay under their parents: (cost, [(change, old path, new path)]).

    Children of the same name are paired first (order is no content). The rest is an assignment of leftover old to
    leftover new children: a pair of the same type is a rename, a pair of other content costs more than dropping both.
    """
    script: list[tuple[str, str, str]] = []
    cost = 0.0
    for name in old.keys() & new.keys():
        a, b = old[name], new[name]
        if isinstance(a, dict) and isinstance(b, dict):
            c, s = _script(a, b, f"{path}{name}.")
            cost, script = cost + c, script + s
        elif _kind(a) != _kind(b) and a is not None and b is not None:
            cost += RETYPE
            script.append(("retyped", f"{path}{name}", f"{path}{name}"))
    gone = sorted(old.keys() - new.keys())
    come = sorted(new.keys() - old.keys())
    place_old, place_new = {n: i for i, n in enumerate(old)}, {n: i for i, n in enumerate(new)}

    def pair(a: str, b: str) -> float:
        x, y = old[a], new[b]
        if isinstance(x, dict) and isinstance(y, dict):
            inner = _script(x, y)[0]
        elif x is None or y is None or _kind(x) == _kind(y):
            inner = 0.0 if x is not None and y is not None else 0.5
        else:
            inner = OTHER_CONTENT
        moved = 0.0 if place_old[a] == place_new[b] else 0.05
        return RENAME + inner + moved + 0.1 * (1 - _likeness(a, b))

    # assignment over the leftovers of each type
    groups: dict[str | None, tuple[list[str], list[str]]] = {}
    for side, names in enumerate((gone, come)):
        for n in names:
            k = _kind((old, new)[side][n])
            groups.setdefault(k, ([], []))[side].append(n)
    loose = groups.pop(None, ([], []))
    for k in loose[0] + loose[1]:  # columns without any value may pair with anything: they join the largest group
        target = max(groups, key=lambda g: sum(map(len, groups[g])), default=None)
        groups.setdefault(target, ([], []))[0 if k in loose[0] else 1].append(k)
    for left, right in groups.values():
        # beside the new children, a column for each old one that is dropped
        costs = np.array([[pair(a, b) - ADD for b in right] + [DELETE] * len(left) for a in left])
        pairs = [(a, right[j]) for a, j in zip(left, assign(costs) if left else []) if j < len(right)]
        for a, b in pairs:
            cost += pair(a, b)
            script.append(("renamed", f"{path}{a}", f"{path}{b}"))
            if isinstance(old[a], dict) and isinstance(new[b], dict):
                script += _script(old[a], new[b], f"{path}{b}.")[1]
        for a in set(left) - {a for a, _ in pairs}:
            cost += DELETE * _size(old[a])
            script.append(("removed", f"{path}{a}", f"{path}{a}"))
        for b in set(right) - {b for _, b in pairs}:
            cost += ADD * _size(new[b])
            script.append(("added", f"{path}{b}", f"{path}{b}"))
    return cost, script


def _leaves(node, path: str) -> dict[str, str | None]:
    return {k: t for n, c in node.items() for k, t in _leaves(c, f"{path}.{n}").items()} if isinstance(node, dict) else {path: node}


def _at(root: dict, path: str):
    for n in path.split("."):
        root = root[n]
    return root


def edit_script(old: dict, new: dict) -> tuple[float, list[tuple[str, str, str]]]:
    """Cheapest script from one tree to another: (cost, [(change, old path, new path)]).

    Fields that ``_script`` leaves removed and added, also within a struct that goes or comes, are moves where type and
    last name agree. A struct that goes stays listed, without what moved out of it.
    """
    cost, script = _script(old, new)
    renames = sorted(((b, a) for change, a, b in script if change == "renamed"), key=lambda x: -x[0].count("."))

    def before(path: str) -> str:  # paths below a renamed struct are those of its new name
        for b, a in renames:
            if path.startswith(f"{b}."):
                path = a + path[len(b) :]
        return path

    sides: dict[tuple, tuple[list, list]] = {}
    for change, a, b in script:
        if change in ("removed", "added"):
            side, path = (0, before(a)) if change == "removed" else (1, b)
            for leaf, kind in _leaves(_at((old, new)[side], path), path).items():
                if kind is not None:
                    sides.setdefault((leaf.rsplit(".", 1)[-1], kind), ([], []))[side].append((leaf, (change, a, b)))
    for left, right in sides.values():
        if not left or not right:
            continue
        costs = np.array([[MOVE + 0.1 * (1 - _likeness(a, b)) - ADD for b, _ in right] + [DELETE] * len(left) for a, _ in left])
        for (a, x), j in zip(left, assign(costs)):
            if j < len(right):
                b, y = right[j]
                cost += MOVE + 0.1 * (1 - _likeness(a, b)) - DELETE - ADD
                script = [z for z in script if not (z == x and before(x[1]) == a) and not (z == y and y[2] == b)]
                script.append(("moved", a, b))
    return cost, script


_STREAM_SCHEMA = "stream_id long, file_id long, pos int, name string, root string, type string, change_kind string, field_name string"


class Walk:
    """One stream's files in order: inherited headers, changes, and each column's name in the stream's first use."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.kinds: dict[str, str | None] = {}
        self.roots: dict[str, str] = {}
        self.first = True

    def file(self, header: list[str] | None, types: list[int] | None) -> list[tuple]:
        """Rows (place, name, root, type, change, field) of the next file: its columns, and its changes."""
        out: list[tuple] = []
        given = [None if t is None or t < 0 else TYPES[t] for t in types or []]
        new = header if header is not None else (self.names or [f"column_{i + 1}" for i in range(len(given))])
        if not new:
            return out
        seen: dict[str, int] = {}
        cols = []
        for n in new:  # repeated names in one header stay apart
            seen[n] = seen.get(n, 0) + 1
            cols.append(n if seen[n] == 1 else f"{n}#{seen[n]}")
        now = {n: (given[i] if i < len(given) else None) for i, n in enumerate(cols)}
        if self.first:
            roots = {n: n for n in cols}
        else:
            before = [(n, self.kinds.get(n)) for n in self.names]
            # the same fields with the same types, in whatever order, need no script
            same = len(before) == len(now) and all(n in now and (now[n] is None or k is None or now[n] == k) for n, k in before)
            script = [] if same else edit_script(tree(before), tree(list(now.items())))[1]
            out += [(None, None, None, None, change, b) for change, _, b in sorted(script)]
            renamed = {b: a for change, a, b in script if change in ("renamed", "moved")}
            roots = {n: self.roots.get(renamed.get(n, n), n) for n in cols}
            taken: set[str] = set()
            for n in cols:  # a column that comes back under a name another lineage holds keeps its own name
                if roots[n] in taken:
                    roots[n] = n
                taken.add(roots[n])
            # a column that is empty in this file keeps the type it had
            now = {n: k if k is not None else self.kinds.get(renamed.get(n, n)) for n, k in now.items()}
        out += [(i, n, roots[n], now[n], None, None) for i, n in enumerate(cols)]
        self.names, self.kinds, self.roots, self.first = cols, now, roots, False
        return out


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by stream, day and file; only the last file's schema is held."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 5]
    stream, walk = None, Walk()
    for batch in batches:
        rows: list[tuple] = []
        for s, file, header, types in zip(*(batch[c].to_pylist() for c in ("stream_id", "file_id", "header", "types"))):
            if s != stream:
                stream, walk = s, Walk()
            rows += [(s, file, *row) for row in walk.file(header, types)]
        columns = list(zip(*rows)) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in _STREAM_SCHEMA.split(", ")])


def _shapes(files: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file_id, sep, header or null, first line), and the data lines with their file's separator."""
    x = lines.select(F.col("line_id").cast("long").alias("line_id"), F.col("file_id").cast("long").alias("file_id"), F.col("line_no").cast("int").alias("line_no"), F.coalesce(F.col("line").cast("string"), F.lit("")).alias("line"))
    count = lambda c: F.length("line") - F.length(F.replace(F.col("line"), F.lit(c), F.lit("")))
    heads = x.where(F.trim("line") != "").groupBy("file_id").agg(*[F.sum(count(c)).alias(f"_{i}") for i, c in enumerate(SEPARATORS)], F.min_by("line", F.struct("line_no", "line_id")).alias("first"))
    sep = F.when((F.col("_0") >= F.col("_1")) & (F.col("_0") >= F.col("_2")), ",").when(F.col("_1") >= F.col("_2"), ";").otherwise("\t")
    heads = heads.select("file_id", "first", sep.alias("sep")).withColumn("cells", _cells(F.col("first"), F.col("sep")))
    # a header has no cell that reads as a value, and at least one name
    is_head = ~F.exists("cells", lambda c: F.coalesce(value_type(c) < 4, F.lit(False))) & F.exists("cells", lambda c: c != "")
    heads = heads.select("file_id", "sep", F.when(is_head, F.col("first")).alias("head_line"), F.when(is_head, F.transform("cells", F.lower)).alias("header"))
    heads = materialize(heads, "heads")
    data = lookup_join(x, heads.select("file_id", "sep", "head_line"), ["file_id"]).where((F.trim("line") != "") & (F.col("head_line").isNull() | (F.col("line") != F.col("head_line"))))
    return heads, data.select("line_id", "file_id", "line_no", _cells(F.col("line"), F.col("sep")).alias("cells"))


def drift(files: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(schema scripts, data lines) of delivered files.

    ``files``: ``file_id, stream_id, file_day``; ``lines``: ``line_id, file_id, line_no, line``. A file without lines has
    an unknown schema and is passed over; lines of unknown files and null streams are ignored; repeated lines count
    once for a type, as they give the same types; other columns are ignored. Streams have at most one file a day, which
    bounds the rows of a stream; lines are only aggregated, never gathered.
    """
    heads, data = _shapes(files, lines)
    cells = data.select("file_id", F.posexplode("cells").alias("pos", "v"))
    kinds = cells.groupBy("file_id", "pos").agg(F.bit_or(F.get(F.array(*[F.lit(1 << i) for i in range(len(TYPES))]), value_type(F.col("v")))).alias("bits"))
    b = F.col("bits")
    # 16 text wins; integers among decimals are decimals; any other mixture is text
    kind = F.when(b.isNull(), -1).when(b == 1, 0).when(b.isin(2, 3), 1).when(b == 4, 2).when(b == 8, 3).otherwise(4)
    types = kinds.withColumn("kind", kind).groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "kind"))), lambda s: s["kind"]).alias("types"))
    known = files.select(F.col("file_id").cast("long").alias("file_id"), F.col("stream_id").cast("long").alias("stream_id"), F.col("file_day").cast("timestamp_ntz").cast("string").alias("file_day")).where("stream_id is not null").dropDuplicates(["file_id"])
    shapes = known.join(heads.select("file_id", "header"), "file_id").join(types, "file_id", "left")
    in_order = by_group(shapes.select("stream_id", "file_id", "file_day", "header", "types"), "stream_id").sortWithinPartitions("stream_id", "file_day", "file_id")
    return in_order.mapInArrow(_walk, _STREAM_SCHEMA), data


def drift_changes(files: DataFrame, lines: DataFrame) -> DataFrame:
    """``stream_id, file_id, change_kind, field_name`` of every file against the one before it in its stream."""
    scripts, _ = drift(files, lines)
    return scripts.where("change_kind is not null").select("stream_id", "file_id", "change_kind", "field_name")


#: Types of the one table, by what a column's files hold.
_WHOLE = {frozenset(["integer"]): "long", frozenset(["decimal"]): "double", frozenset(["integer", "decimal"]): "double", frozenset(["boolean"]): "boolean"}
_OWN = ["line_id", "file_id", "stream_id", "line_no", "extra"]


def table_columns(kinds: dict[str, set[str]]) -> list[tuple[str, str, str]]:
    """(lineage, column, type) of the one table: a column for each lineage in order of name, of the type all its files fit.

    Whole and decimal numbers make decimals, any other mixture texts. A name that the table needs itself gets ``_value``.
    """
    return [(n, f"{n}_value" if n in _OWN else n, _WHOLE.get(frozenset(k), "string")) for n, k in sorted(kinds.items())]


def drift_table(files: DataFrame, lines: DataFrame) -> DataFrame:
    """All data lines in one typed table: ``line_id, file_id, stream_id, line_no``, a column per lineage, and ``extra``.

    A lineage is a column through all its renames and moves, under the name its stream used first; streams whose lineages
    have the same name share the column. The scripts are compiled into the place of each column in each file, and that
    projection is applied to the file's lines. Columns a file lacks and empty cells are null; cells beyond a file's
    columns are kept in the map ``extra`` by their position. Timestamps stay texts, as a file does not say their zone.
    The names and types come to the driver, which makes the schema of them; no line does.
    """
    scripts, data = drift(files, lines)
    scripts = materialize(scripts.where("change_kind is null").select("stream_id", "file_id", "pos", "root", "type"), "scripts")
    kinds: dict[str, set[str]] = {}
    for root, kind in scripts.select("root", "type").distinct().collect():
        kinds.setdefault(root, set()).update([kind] if kind else [])
    columns = table_columns(kinds)
    names = F.transform(F.array_sort(F.collect_list(F.struct("pos", "root"))), lambda s: s["root"])
    at = F.array(*[F.array_position("names", n).cast("int") for n, _, _ in columns]) if columns else F.lit(None).cast("array<int>")
    plan = scripts.groupBy("file_id").agg(F.first("stream_id").alias("stream_id"), names.alias("names"))
    plan = materialize(plan.select("file_id", "stream_id", F.size("names").alias("width"), at.alias("at")), "plan")
    x = lookup_join(data, plan, ["file_id"])
    cell = lambda i: F.nullif(F.get("cells", F.get("at", F.lit(i)) - 1), F.lit(""))
    typed = [(cell(i) if kind == "string" else cell(i).try_cast(kind)).alias(name) for i, (_, name, kind) in enumerate(columns)]
    width = F.coalesce("width", F.lit(0))
    beyond = F.filter(F.transform("cells", lambda c, i: F.struct((i + 1).alias("key"), c.alias("value"))), lambda s: (s["key"] > width) & (s["value"] != ""))
    return x.select("line_id", "file_id", "stream_id", "line_no", *typed, F.map_from_entries(beyond).alias("extra"))

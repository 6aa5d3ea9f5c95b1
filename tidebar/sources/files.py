"""Readers for bar and tick files of unknown layout, archives, and a catalog of result files."""

from __future__ import annotations

import csv
import io
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quality import detect_roles, try_number
from ..scale import lookup_join

BAR_NAMES = ["Date", "c1", "c2", "c3", "c4", "vol"]
KLINE_NAMES = ["datetime", "open", "high", "low", "close", "volume"]


def _text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_bars_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless bars whose four price columns may come in any order: ``ts, open, high, low, close, volume``.

    Numbers that cannot be read become null; the roles of the columns are found by the order relations of a bar, and a
    file that fits no order raises.
    """
    raw = spark.read.schema(_text_schema(BAR_NAMES)).csv(path, header=False)
    x = raw.select("Date", *[try_number(c).alias(c) for c in BAR_NAMES[1:]])
    roles = detect_roles(x, BAR_NAMES[1:5])
    return x.select(F.col("Date").try_cast("timestamp_ntz").alias("ts"), *[F.col(roles[k]).alias(k) for k in ("open", "high", "low", "close")], F.col("vol").alias("volume"))


def head_lines(spark: SparkSession, path: str, n: int = 50) -> list[str]:
    """First lines of a file or of the first file of a folder; only these are read."""
    return [r[0] for r in spark.read.text(path).limit(n).collect()]


def tab_or_comma(first_line: str) -> str:
    return "\t" if first_line.count("\t") >= 3 else ","


def sniff(lines: list[str]) -> str:
    """Delimiter by the csv module's vote over ``,`` tab ``;`` and ``|``; tab where it cannot tell."""
    try:
        return csv.Sniffer().sniff("\n".join(lines), delimiters=",\t;|").delimiter
    except csv.Error:
        return "\t"


def read_kline_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bars with an optional header in any case and delimiter: KLINE_NAMES, without rows that lack a time or a close above 0."""
    lines = head_lines(spark, path, 20)
    if not lines:
        raise ValueError(f"{path} is empty")
    for sep in dict.fromkeys([sniff(lines), "\t", ","]):
        header = [h.strip().lower() for h in lines[0].split(sep)]
        if len(header) >= len(KLINE_NAMES):
            break
    else:
        raise ValueError("no delimiter gives six columns")
    if "datetime" in header:
        missing = [n for n in KLINE_NAMES if n not in header]
        if missing:
            raise ValueError(f"columns missing: {missing}")
        x = spark.read.schema(_text_schema([f"{h}_{i}" if header.index(h) != i else h for i, h in enumerate(header)])).csv(path, header=True, sep=sep, enforceSchema=True)
    else:
        x = spark.read.schema(_text_schema(KLINE_NAMES)).csv(path, header=False, sep=sep)
    x = x.select(F.trim("datetime").try_cast("timestamp_ntz").alias("datetime"), *[try_number(c).alias(c) for c in KLINE_NAMES[1:]])
    return x.where("datetime is not null and close > 0")


def read_ticks_csv(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Headerless ticks of four (``dt, bid, ask, vol``) or five (date, time, ...) columns as text, with file and line order.

    Lines with more than five cells are skipped, short ones are filled with nulls. Whether a file has five columns is
    voted on by all of its rows.
    """
    sep = tab_or_comma((head_lines(spark, path, 1) or [""])[0]) if sep is None else sep
    names = ["c0", "c1", "c2", "c3", "c4", "c5"]
    x = spark.read.schema(_text_schema(names)).csv(path, header=False, sep=sep, mode="PERMISSIVE").select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("seq"))
    x = x.where("c5 is null").drop("c5")
    two = F.coalesce(F.trim("c0").rlike(r"^\d{8}$") & F.trim("c1").rlike(r"^\d{6,9}$"), F.lit(False))
    vote = x.groupBy("file").agg((F.avg(two.cast("double")) > 0.8).alias("five"))
    x = lookup_join(x, vote, ["file"], "inner")
    pick = lambda five, four: F.when(F.col("five"), five).otherwise(four)
    return x.select("file", "seq", pick(F.concat_ws(" ", "c0", "c1"), F.col("c0")).alias("dt"), pick(F.col("c2"), F.col("c1")).alias("bid"), pick(F.col("c3"), F.col("c2")).alias("ask"), pick(F.col("c4"), F.col("c3")).alias("vol"))


def choose_member(names: list[str]) -> str:
    """The text file of an archive to read: names with ``dat_ascii`` first, then in order; raises if there is none."""
    fit = sorted((n for n in names if n.lower().endswith((".csv", ".txt"))), key=lambda n: ("dat_ascii" not in n.lower(), n))
    if not fit:
        raise ValueError("the archive holds no .csv or .txt file")
    return fit[0]


def read_zipped_lines(spark: SparkSession, folder: str, glob: str = "*.zip") -> DataFrame:
    """``file, member, line_no, line`` of each archive's chosen member; an archive is unpacked where it is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "content")
    if files.isEmpty():
        raise ValueError(f"no {glob} in {folder}")

    def unpack(frames):
        import pandas as pd

        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    member = choose_member(z.namelist())
                    with z.open(member) as raw:
                        text = io.TextIOWrapper(raw, "utf-8-sig", "replace")
                        part: list[tuple] = []
                        for n, line in enumerate(text, 1):
                            part.append((path, member, n, line.rstrip("\r\n")))
                            if len(part) == 50_000:
                                yield pd.DataFrame(part, columns=["file", "member", "line_no", "line"])
                                part = []
                        yield pd.DataFrame(part, columns=["file", "member", "line_no", "line"])

    return files.mapInPandas(unpack, "file string, member string, line_no long, line string")


def file_catalog(spark: SparkSession, root: str, glob: str = "*.html") -> DataFrame:
    """``name, display, token, folder, modified, size_kb`` of the files below a folder, caches and version control left out."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "modificationTime", "length")
    token = F.regexp_extract(F.col("path"), "^(?:file:)?/*" + _quoted(root) + "/+(.*)$", 1)
    name = F.element_at(F.split("token", "/"), -1)
    folder = F.coalesce(F.nullif(F.regexp_extract("token", "^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))
    x = x.withColumn("token", token).where(~F.col("token").rlike(r"(^|/)(\.git|__pycache__)/"))
    return x.select(name.alias("name"), display_name(name).alias("display"), "token", folder.alias("folder"), F.col("modificationTime").alias("modified"), F.round(F.col("length") / 1024, 1).alias("size_kb")).orderBy(F.desc("modified"), "token")


def _quoted(root: str) -> str:
    return "\\Q" + root.removeprefix("file:").strip("/") + "\\E"


def display_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"(?i)\.html$", ""), r"[_]+", " ")


def search(catalog: DataFrame, text: str) -> DataFrame:
    """Files whose name, shown name or folder holds the text, in any case."""
    key = text.strip().lower()
    return catalog.where(F.lower("name").contains(key) | F.lower("display").contains(key) | F.lower("folder").contains(key))


def page(catalog: DataFrame, shown: int, step: int = 10) -> DataFrame:
    """The rows a list shows after it has grown by ``step`` until it holds ``shown``."""
    return catalog.limit(-(-max(shown, 1) // step) * step)


def safe_path(token: Column) -> Column:
    """Whether a decoded relative path stays below its root and names an .html file."""
    path = F.url_decode(token)
    return ~path.startswith("/") & ~path.rlike(r"(^|/)\.\.(/|$)") & F.lower(path).endswith(".html")


def read_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")

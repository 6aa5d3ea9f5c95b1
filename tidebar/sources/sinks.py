"""Writers of bars and results."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _with_text_time(bars: DataFrame) -> DataFrame:
    return bars.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def write_monthly_bars(bars: DataFrame, path: str) -> None:
    """Headerless CSV by month."""
    x = _with_text_time(bars).withColumn("month", F.substring("ts", 1, 7))
    x.write.mode("overwrite").partitionBy("month").csv(path, header=False)


def write_all_bars(bars: DataFrame, path: str) -> None:
    """Headerless CSV in order of time: files are range-partitioned and sorted, so their concatenation is sorted."""
    x = _with_text_time(bars)
    x.repartitionByRange("ts").sortWithinPartitions("ts").write.mode("overwrite").csv(path, header=False)


def write_results(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Detail, transactions, trade statistics, parameters: parquet, nothing if there are no rows."""
    if not df.isEmpty():
        df.write.mode(mode).parquet(path)


def write_evaluation(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_sweep_stats(stats: DataFrame, path: str) -> bool:
    """Statistics of a sweep, written only if it has more than one parameter set; whether they were."""
    several = stats.select("param_id").distinct().limit(2).count() > 1
    if several:
        write_results(stats, path)
    return several


def write_trade_stats(stats: DataFrame, trades: DataFrame, path: str) -> None:
    """Both tables of the trade statistics in one folder."""
    write_results(stats, f"{path}/stats")
    write_results(trades, f"{path}/trades")


def write_parameters(fit: DataFrame, folder: str, symbol: str, period: str) -> str:
    """Fitted parameters as JSON under the name of their symbol and period, which is returned."""
    name = parameter_name(symbol, period)
    fit.coalesce(1).write.mode("overwrite").json(f"{folder}/{name}")
    return name


def append_range_stats(metrics: DataFrame, path: str) -> None:
    """Metrics appended under their period and direction, beside earlier ones; each call is a ``sheet`` with the first free number."""
    spark = metrics.sparkSession
    try:
        taken = spark.read.parquet(path).agg(F.max("sheet")).first()[0] or 0
    except AnalysisException:  # nothing is there yet
        taken = 0
    metrics.withColumn("sheet", F.lit(taken + 1)).write.mode("append").partitionBy("period", "direction").parquet(path)


def parameter_name(symbol: str, period: str) -> str:
    return f"garch_params_{symbol}_{period}"


def summary(book: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """The console report as rows: bars, final capital and trades of each run."""
    n = book.groupBy(*keys).agg(F.count("*").alias("bars"), F.max("ts").alias("until"))
    return stats.join(n, keys)

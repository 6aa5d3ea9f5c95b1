"""Capital over signals, trades, and what they went through."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scale import last_known, lookup_join
from ..session import materialize

#: Range joins of trades and bars go through buckets of so many bars.
RANGE_BUCKET = 256
#: Bars of a run that are added up together.
BLOCK = 8192


def ledger(signals: DataFrame, keys: list[str], side: int = 1, capital: float = 100.0, commission: float = 0.0) -> DataFrame:
    """Capital at every bar: ``keys, bar_idx, ts, holding_signal, execution, close_type, capital, percent,
    peak`` (the highest capital so far).

    An entry costs the commission and is not marked to market; a position is marked at each close; an exit multiplies
    the capital by exit over entry (long) or entry over exit (short), which is ``percent``. Costs are carried, factors
    multiplied and peaks taken within blocks of bars first, and over a run's blocks with one row each.
    """
    x = signals.select(*keys, "bar_idx", "ts", "holding_signal", "have_holding", "execution", "close_type", "close").withColumn("_b", F.floor(F.col("bar_idx") / BLOCK))
    x = materialize(x, "signals")
    opened = F.col("holding_signal") == 1
    closed = (F.col("holding_signal") == 0) & (F.col("have_holding") == 1)
    x = last_known(x.withColumn("_e", F.when(opened, F.col("execution"))), keys, "_b", ["bar_idx"], "_e", "_cost")
    over = F.try_divide if side > 0 else lambda a, b: F.try_divide(b, a)
    gain, mark = over(F.col("execution"), F.col("_cost")), over(F.col("close"), F.col("_cost"))
    x = x.withColumn("percent", F.when(closed, gain)).withColumn("_mark", F.when(F.col("holding_signal") == 3, mark).otherwise(1.0))
    x = materialize(x.withColumn("_f", F.when(opened, F.lit(1.0 - commission)).when(closed, gain).otherwise(1.0)).drop("_e", "_cost", "have_holding", "close"), "factors")
    inner = Window.partitionBy(*keys, "_b").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # within a block capital and peak are multiples of what the run had when it began
    x = x.withColumn("_k", F.product("_f").over(inner)).withColumn("_shown", F.col("_k") * F.col("_mark"))
    x = x.withColumn("_top", F.max("_shown").over(inner))
    blocks = x.groupBy(*keys, "_b").agg(F.max_by("_k", "bar_idx").alias("_k"), F.max("_shown").alias("_top"))
    blocks = blocks.withColumn("_start", F.lit(capital) * F.coalesce(F.product("_k").over(before), F.lit(1.0)))
    blocks = blocks.withColumn("_high", F.max(F.col("_start") * F.col("_top")).over(before)).select(*keys, "_b", "_start", "_high")
    x = x.drop("_k").join(blocks, [*keys, "_b"])
    # greatest passes over the null of the first block
    peak = F.greatest(F.col("_start") * F.col("_top"), F.col("_high"))
    return x.select(*keys, "bar_idx", "ts", "holding_signal", "execution", "close_type", (F.col("_start") * F.col("_shown")).alias("capital"), "percent", peak.alias("peak"))


def transactions(book: DataFrame, keys: list[str], side: int = 1) -> DataFrame:
    """One row per entry and exit: ``keys, bar_idx, ts, type, price, close_type, capital, percent`` (entries: nulls)."""
    t = book.where("holding_signal = 1 or percent is not null")
    opened = F.col("holding_signal") == 1
    kind = F.when(opened, "long" if side > 0 else "short").otherwise("sell" if side > 0 else "buy")
    keep = lambda c: F.when(~opened, F.col(c)).alias(c)
    return t.select(*keys, "bar_idx", "ts", kind.alias("type"), F.col("execution").alias("price"), keep("close_type"), keep("capital"), keep("percent"))


def trades(book: DataFrame, keys: list[str]) -> DataFrame:
    """Entries paired with the exit that follows: ``keys, trade_id, entry_idx, entry_ts, entry_price, exit_*, close_type, percent, capital``."""
    t = book.where("holding_signal = 1 or percent is not null")
    w = Window.partitionBy(*keys).orderBy("bar_idx")  # rows are trades here, not bars
    nxt = lambda c: F.lead(c).over(w)
    x = t.select(*keys, F.col("bar_idx").alias("entry_idx"), F.col("ts").alias("entry_ts"), F.col("execution").alias("entry_price"), "holding_signal", nxt("bar_idx").alias("exit_idx"), nxt("ts").alias("exit_ts"), nxt("execution").alias("exit_price"), nxt("close_type").alias("close_type"), nxt("percent").alias("percent"), nxt("capital").alias("capital"))
    x = x.where("holding_signal = 1 and exit_idx is not null and percent is not null").drop("holding_signal")
    return x.withColumn("trade_id", F.row_number().over(Window.partitionBy(*keys).orderBy("entry_idx")))


def bars_in_trades(trade: DataFrame, bars: DataFrame, keys: list[str], bar_keys: list[str]) -> DataFrame:
    """Each trade with the bars from entry to exit: a range join by buckets of bar positions, so it is an equi-join."""
    t = trade.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("entry_idx") / RANGE_BUCKET), F.floor(F.col("exit_idx") / RANGE_BUCKET))))
    b = bars.select(*bar_keys, "bar_idx", "ts", "open", "high", "low", "close").withColumn("_bucket", F.floor(F.col("bar_idx") / RANGE_BUCKET))
    return t.join(b, [*bar_keys, "_bucket"]).where("bar_idx between entry_idx and exit_idx").drop("_bucket")


def trade_extremes(trade: DataFrame, bars: DataFrame, keys: list[str], bar_keys: list[str]) -> DataFrame:
    """Best price of each trade, and the worst before it, with where and when; first bars win ties."""
    inside = bars_in_trades(trade, bars, keys, bar_keys)
    by = [*keys, "trade_id"]
    at = F.struct("bar_idx", "ts", F.col("high").alias("price"))
    top = inside.groupBy(*by).agg(F.max_by(at, F.struct("high", -F.col("bar_idx"))).alias("top"))
    before = inside.join(top, by).where(F.col("bar_idx") <= F.col("top.bar_idx"))
    low = before.groupBy(*by).agg(F.first("top").alias("top"), F.min_by(F.struct("bar_idx", "ts", F.col("low").alias("price")), F.struct("low", "bar_idx")).alias("dip"))
    x = trade.join(low, by)
    pct = lambda c: (F.try_divide(F.col(c), F.col("entry_price")) - 1) * 100
    return x.select(
        *by, "entry_idx", "entry_ts", "entry_price", "exit_idx", "exit_ts", "exit_price", (F.col("exit_idx") - F.col("entry_idx") + 1).alias("holding_bars"), pct("exit_price").alias("realized_pct"),
        pct("top.price").alias("max_profit_pct"), F.col("top.bar_idx").alias("max_profit_idx"), F.col("top.ts").alias("max_profit_ts"), F.col("top.price").alias("max_profit_price"),
        pct("dip.price").alias("max_loss_pct"), F.col("dip.bar_idx").alias("max_loss_idx"), F.col("dip.ts").alias("max_loss_ts"), F.col("dip.price").alias("max_loss_price"),
    )


def entry_to_max_profit(trade: DataFrame, bars: DataFrame, keys: list[str], bar_keys: list[str]) -> DataFrame:
    """Loss since the peak on the way from entry to each trade's best bar, worked out from extremes (no ordered walk).

    The peak is the highest high after the entry bar if it tops the entry's close, else that close; the trough is the
    peak bar's close or a lower low after it, up to the best bar.
    """
    by = [*keys, "trade_id"]
    inside = bars_in_trades(trade, bars, keys, bar_keys)
    top = inside.groupBy(*by).agg(F.max_by(F.struct("bar_idx", "ts", "high"), F.struct("high", -F.col("bar_idx"))).alias("top"))
    seg = inside.join(top, by).where(F.col("bar_idx") <= F.col("top.bar_idx"))
    first = F.col("bar_idx") == F.col("entry_idx")
    peak = seg.groupBy(*by).agg(F.first("top").alias("top"), F.max(F.when(first, F.col("close"))).alias("c0"), F.max_by(F.struct("high", "bar_idx", "close"), F.when(~first, F.struct("high", -F.col("bar_idx")))).alias("pk"))
    higher = F.coalesce(F.col("pk.high") > F.col("c0"), F.lit(False))
    peak = peak.select(*by, "top", F.when(higher, F.col("pk.high")).otherwise(F.col("c0")).alias("peak"), F.when(higher, F.col("pk.bar_idx")).alias("k"), F.when(higher, F.col("pk.close")).otherwise(F.col("c0")).alias("start"))
    lows = seg.drop("top").join(peak.select(*by, "k"), by).where(F.col("bar_idx") > F.coalesce("k", "entry_idx")).groupBy(*by).agg(F.min("low").alias("low"))
    x = trade.join(peak, by).join(lows, by, "left")
    drop = F.col("peak") - F.least("start", F.coalesce("low", "start"))
    return x.select(
        *by, "entry_idx", "entry_ts", "entry_price", F.col("top.bar_idx").alias("max_profit_idx"), F.col("top.ts").alias("max_profit_ts"), ((F.try_divide(F.col("top.high"), F.col("entry_price")) - 1) * 100).alias("max_profit_pct"),
        (F.col("top.bar_idx") - F.col("entry_idx") + 1).alias("segment_bars"), F.col("peak").alias("segment_peak"), drop.alias("segment_withdrawal"), F.when(F.col("peak") != 0, drop / F.col("peak") * 100).alias("withdrawal_pct"),
    )


def outcome_stats(book: DataFrame, keys: list[str], side: int = 1) -> DataFrame:
    """One row per run: final capital (100 without a finished trade pair), trades (a half for an open one), counts by
    close type, the final peak of the capital (trough for shorts) and the way back since it, and the true largest drawdown.
    """
    sign = F.lit(float(side))
    tx = F.count_if(F.expr("holding_signal = 1 or percent is not null"))
    base = book.groupBy(*keys).agg(
        tx.alias("_tx"), F.max_by("capital", F.when(F.col("percent").isNotNull(), F.col("bar_idx"))).alias("_last"), F.count_if(F.col("close_type") == 1).alias("closed_by_withdrawal"), F.count_if(F.col("close_type") == 2).alias("closed_by_speed"),
        F.max_by(F.struct("bar_idx", "capital"), F.struct(F.col("capital") * sign, -F.col("bar_idx"))).alias("_top"),
    )
    back = lookup_join(book, base.select(*keys, "_top"), keys).where(F.col("bar_idx") >= F.col("_top.bar_idx")).groupBy(*keys).agg(F.min(F.col("capital") * sign).alias("_low"))
    worst = book.groupBy(*keys).agg(F.max(F.col("peak") - F.col("capital")).alias("max_drawdown"))
    x = base.join(back, keys).join(worst, keys)
    final = F.when(F.col("_tx") > 1, F.round("_last", 2)).otherwise(100.0)
    return x.select(*keys, final.alias("capital"), (F.col("_tx") / 2).alias("trade_num"), "closed_by_withdrawal", "closed_by_speed", F.col("_top.capital").alias("outcome_high"), (F.col("_top.capital") * sign - F.col("_low")).alias("biggest_back"), "max_drawdown")


def capital_anchors(book: DataFrame, keys: list[str]) -> DataFrame:
    """``anchor`` at each bar: capital of the last exit so far, the run's first capital before any."""
    first = book.groupBy(*keys).agg(F.min_by("capital", "bar_idx").alias("_first"))
    x = book.withColumns({"_b": F.floor(F.col("bar_idx") / 8192), "_point": F.when(F.col("percent").isNotNull(), F.col("capital"))})
    x = last_known(x, keys, "_b", ["bar_idx"], "_point", "_p")
    return x.join(first, keys).select(*keys, "bar_idx", "ts", F.coalesce("_p", "_first").alias("anchor"))


def observe(trade: DataFrame, bars: DataFrame, bar_keys: list[str], near: int, pad: int = 100) -> DataFrame:
    """Bars around the trade whose entry is nearest to a position (earlier on a tie), with its profit: per key."""
    one = trade.groupBy(*bar_keys).agg(F.min_by(F.struct("entry_idx", "exit_idx", "entry_price", "exit_price"), F.struct(F.abs(F.col("entry_idx") - near), "entry_idx")).alias("t"))
    x = bars.join(one, bar_keys).where((F.col("bar_idx") >= F.col("t.entry_idx") - pad) & (F.col("bar_idx") <= F.col("t.exit_idx") + pad))
    pnl = F.col("t.exit_price") - F.col("t.entry_price")
    return x.select(*bar_keys, "bar_idx", "ts", "open", "high", "low", "close", F.col("t.entry_idx").alias("entry_idx"), F.col("t.exit_idx").alias("exit_idx"), pnl.alias("pnl"), (F.try_divide(pnl, F.col("t.entry_price")) * 100).alias("pnl_pct"))

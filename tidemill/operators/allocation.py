"""Monthly trend allocation: weights, rebalancing, a backtest against a benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scans
from .indicators import trend_up


def monthly_closes(bars: DataFrame) -> DataFrame:
    """The last close of each symbol and month."""
    return bars.groupBy("symbol", F.date_trunc("month", "ts").cast("date").alias("month")).agg(F.max_by("close", "ts").alias("close"))


def target_weights(closes: DataFrame, universe: DataFrame, n: int = 10) -> DataFrame:
    """Per symbol of ``universe`` an equal share if its trend is up, else 0; ``error`` without a history."""
    size = universe.agg(F.count_distinct("symbol").alias("_size"))
    df = universe.select("symbol").distinct().crossJoin(F.broadcast(size)).join(trend_up(closes, n), "symbol", "left")
    error = F.when(F.col("months").isNull(), "missing price history").otherwise(F.col("error"))
    weight = F.when(error.isNull(), F.when(F.col("up"), 1.0 / F.col("_size")).otherwise(F.lit(0.0)))
    return df.select("symbol", weight.alias("weight"), error.alias("error"))


def rebalance(weights: DataFrame, holdings: DataFrame, equity: float, min_trade: float = 1.0) -> DataFrame:
    """Orders (symbol, side, notional, seq) from holdings (symbol, value) to weights: sells first, then by symbol; small ones are left out."""
    if equity <= 0:
        raise ValueError("nothing to allocate: equity is not above zero")
    both = weights.select("symbol", "weight").join(holdings.select("symbol", "value"), "symbol", "full_outer")
    diff = equity * F.coalesce("weight", F.lit(0.0)) - F.coalesce("value", F.lit(0.0))
    df = both.withColumn("_d", diff).filter(F.abs("_d") >= min_trade)
    df = df.select("symbol", F.when(F.col("_d") > 0, "buy").otherwise("sell").alias("side"), F.bround(F.abs("_d"), 2).alias("notional"))
    return df.withColumn("seq", F.row_number().over(Window.orderBy(F.col("side").desc(), "symbol")))


def guard_pending(plan: DataFrame, open_orders: DataFrame) -> DataFrame:
    """``plan`` with ``blocked``: whether any order is still open."""
    pending = open_orders.agg((F.count("*") > 0).alias("blocked"))
    return plan.crossJoin(F.broadcast(pending))


def monthly_backtest(closes: DataFrame, benchmark: str, n: int = 10, cost: float = 0.001) -> DataFrame:
    """One row: months, total return of the strategy and of holding ``benchmark``, the strategy's drawdown (0 or below).

    Weights known at a month's close earn the next month; a change of weights costs ``cost`` times the turnover.
    All symbols need the same months.
    """
    by = Window.partitionBy("symbol").orderBy("month")
    df = closes.withColumns({"_i": F.row_number().over(by), "_mean": F.avg("close").over(by.rowsBetween(-(n - 1), 0)), "_next": F.lead("close").over(by) / F.col("close") - 1})
    size = closes.agg(F.count_distinct("symbol").alias("_size"))
    df = df.crossJoin(F.broadcast(size)).filter(F.col("_i") >= n).withColumn("_w", F.when(F.col("close") > F.col("_mean"), 1.0 / F.col("_size")).otherwise(F.lit(0.0)))
    df = df.withColumn("_turn", F.abs(F.col("_w") - F.coalesce(F.lag("_w").over(by), F.lit(0.0)))).filter("_next is not null")
    per = df.groupBy("month").agg((F.sum(F.col("_w") * F.col("_next")) - cost * F.sum("_turn")).alias("r"), F.max(F.when(F.col("symbol") == benchmark, F.col("_next"))).alias("b"))
    cut = scans.time_block("month", "1 day", 10_000)
    per = scans.running(per, [], "month", cut, {"_e": ("sum", F.ln(1 + F.col("r"))), "_b": ("sum", F.ln(1 + F.col("b")))})
    per = scans.running(per.withColumns({"_e": F.exp("_e"), "_b": F.exp("_b")}), [], "month", cut, {"_peak": ("max", F.col("_e"))})
    per = per.withColumn("_d", F.col("_e") / F.greatest(F.lit(1.0), F.col("_peak")) - 1)
    return per.agg(F.count("*").alias("months"), (F.max_by("_e", "month") - 1).alias("strategy_total_return"), (F.max_by("_b", "month") - 1).alias("benchmark_total_return"), F.least(F.lit(0.0), F.min("_d")).alias("strategy_max_drawdown"))

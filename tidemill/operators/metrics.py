"""Performance metrics of equity curves, trades and events, by any keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scans
from .event_study import compound


def _order(keys: list[str], by: str):  # noqa: ANN202
    return Window.partitionBy(*keys).orderBy(by)


def total_return(eq: DataFrame, keys: list[str], by: str = "bar_idx") -> DataFrame:
    return eq.groupBy(*keys).agg((F.max_by("equity", by) / F.min_by("equity", by) - 1).alias("total_return"))


def trade_stats(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Trades, win rate, mean win and loss, expectancy, profit factor (null without loss). Zero results count as trades only."""
    win, loss = F.when(F.col("pnl") > 0, F.col("pnl")), F.when(F.col("pnl") < 0, F.col("pnl"))
    zero = F.lit(0.0)
    out = trades.groupBy(*keys).agg(F.count("*").alias("trades"), (F.count(win) / F.count("*")).alias("win_rate"), F.coalesce(F.avg(win), zero).alias("average_win"), F.coalesce(F.avg(loss), zero).alias("average_loss"), (F.count(loss) / F.count("*")).alias("_l"), F.sum(win).alias("_w"), F.sum(loss).alias("_s"))
    out = out.withColumn("expectancy", F.col("win_rate") * F.col("average_win") + F.col("_l") * F.col("average_loss"))
    return out.withColumn("profit_factor", F.when(F.col("_s") < 0, F.coalesce("_w", zero) / -F.col("_s"))).drop("_l", "_w", "_s")


def with_drawdown(eq: DataFrame, keys: list[str], by: str = "bar_idx", start: float | None = None) -> DataFrame:
    """``eq`` with its running ``peak`` (at least ``start``) and ``drawdown`` below it, a positive fraction."""
    peak = F.max("equity").over(_order(keys, by).rowsBetween(Window.unboundedPreceding, 0))
    peak = F.greatest(peak, F.lit(start)) if start is not None else peak
    return eq.withColumn("peak", peak).withColumn("drawdown", F.when(F.col("peak") > 0, (F.col("peak") - F.col("equity")) / F.col("peak")).otherwise(F.lit(0.0)))


def max_drawdown(eq: DataFrame, keys: list[str], by: str = "bar_idx", start: float | None = None) -> DataFrame:
    return with_drawdown(eq, keys, by, start).groupBy(*keys).agg(F.max("drawdown").alias("max_drawdown"))


def with_returns(eq: DataFrame, keys: list[str], by: str = "bar_idx") -> DataFrame:
    """``eq`` with ``r``, the change from the row before; null on the first."""
    return eq.withColumn("r", F.col("equity") / F.lag("equity").over(_order(keys, by)) - 1)


def sharpe(eq: DataFrame, keys: list[str], periods: int, by: str = "bar_idx") -> DataFrame:
    """Mean over population deviation of returns, times the root of ``periods``; null without deviation."""
    std = F.stddev_pop("r")
    return with_returns(eq, keys, by).groupBy(*keys).agg(F.when(std > 0, F.avg("r") / std * F.sqrt(F.lit(float(periods)))).alias("sharpe"))


def sortino(eq: DataFrame, keys: list[str], periods: int, by: str = "bar_idx") -> DataFrame:
    """As ``sharpe`` over the root mean square of losses among all returns; null without a loss."""
    down = F.sqrt(F.sum(F.when(F.col("r") < 0, F.col("r") * F.col("r"))) / F.count("r"))
    return with_returns(eq, keys, by).groupBy(*keys).agg(F.when(down > 0, F.avg("r") / down * F.sqrt(F.lit(float(periods)))).alias("sortino"))


def losing_streak(trades: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The longest run of losses."""
    w = _order(keys, by)
    runs = trades.withColumn("_run", F.sum((F.col("pnl") >= 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*keys, "_run").agg(F.count_if(F.col("pnl") < 0).alias("n"))
    return runs.groupBy(*keys).agg(F.max("n").alias("losing_streak"))


def exposure(eq: DataFrame, keys: list[str]) -> DataFrame:
    return eq.groupBy(*keys).agg(F.avg(F.abs("position")).alias("exposure"))


def recovery_periods(eq: DataFrame, keys: list[str], by: str = "bar_idx") -> DataFrame:
    """Bars of the first run under a peak; 0 if there is none, null if it never ends."""
    df = with_drawdown(eq, keys, by).withColumn("_under", (F.col("equity") < F.col("peak")).cast("int"))
    w = _order(keys, by)
    df = df.withColumn("_run", F.sum(F.when((F.col("_under") == 1) & (F.coalesce(F.lag("_under").over(w), F.lit(0)) == 0), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = (F.col("_run") == 1) & (F.col("_under") == 1)
    out = df.groupBy(*keys).agg(F.count_if(first).alias("n"), F.max(F.when(first, F.col(by))).alias("_end"), F.max(by).alias("_last"))
    return out.select(*keys, F.when(F.col("n") == 0, F.lit(0)).when(F.col("_end") < F.col("_last"), F.col("n")).alias("recovery_periods"))


def longest_recovery(eq: DataFrame, keys: list[str], by: str = "bar_idx") -> DataFrame:
    """The most rows between a row and the last peak at or before it."""
    df = with_drawdown(eq, keys, by).withColumn("_n", F.row_number().over(_order(keys, by)))
    peak_at = F.last(F.when(F.col("equity") >= F.col("peak"), F.col("_n")), ignorenulls=True).over(_order(keys, by).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_d", F.col("_n") - peak_at).groupBy(*keys).agg(F.max("_d").alias("longest_recovery"))


def longest_recovery_hours(events: DataFrame, keys: list[str], ts: str, tail: DataFrame | None = None, order: str = "bar_idx") -> DataFrame:
    """The longest time from a peak of event equity (which starts at 1) to a later event below it, in hours.

    ``tail`` (keys, ``end_ts``) adds the time from the last peak to the end where equity ends below it. Time before
    the first peak doesn't count.
    """
    df = with_drawdown(events, keys, order, 1.0)
    upto = _order(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_peak_ts", F.last(F.when(F.col("equity") >= F.col("peak"), F.col(ts)), ignorenulls=True).over(upto))
    below = F.col("equity") < F.col("peak")
    hours = lambda a, b: (F.unix_micros(F.to_timestamp(a)) - F.unix_micros(F.to_timestamp(b))) / 3.6e9
    out = df.groupBy(*keys).agg(F.coalesce(F.max(F.when(below, hours(F.col(ts), F.col("_peak_ts")))), F.lit(0.0)).alias("h"), F.max_by(F.when(below, F.col("_peak_ts")), order).alias("_open"))
    if tail is not None:
        out = out.join(tail, keys, "left").withColumn("h", F.greatest("h", F.coalesce(hours(F.col("end_ts"), F.col("_open")), F.lit(0.0))))
    return out.select(*keys, F.col("h").alias("longest_recovery_hours"))


def event_stats(events: DataFrame, keys: list[str]) -> DataFrame:
    """Events, compound and mean return, share of positive ones."""
    return events.groupBy(*keys).agg(F.count("*").alias("events"), compound().alias("compound_return"), F.avg("ret").alias("mean_event_return"), F.avg((F.col("ret") > 0).cast("double")).alias("positive_fraction"))


def segment_returns(events: DataFrame, keys: list[str]) -> DataFrame:
    """Per keys and segment with events: events and compound return."""
    return events.groupBy(*keys, "segment_id").agg(F.count("*").alias("events"), compound().alias("segment_return"))


def cell_summary(events: DataFrame, keys: list[str]) -> DataFrame:
    """``event_stats`` with the mean return of segments that have events, and how many do."""
    segs = segment_returns(events, keys).groupBy(*keys).agg(F.avg("segment_return").alias("mean_segment_return"), F.count("*").alias("eligible_segments"))
    return event_stats(events, keys).join(segs, keys)


def segment_summary(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Over segments (total_return, max_drawdown, trades): compound and mean return, share positive, worst drawdown, trades; ``error`` where one lost all."""
    out = metrics.groupBy(*keys).agg(
        F.count("*").alias("segments"), compound("total_return").alias("compound_return"), F.avg("total_return").alias("mean_segment_return"),
        F.avg((F.col("total_return") > 0).cast("double")).alias("positive_segment_fraction"), F.max("max_drawdown").alias("max_segment_drawdown"), F.sum("trades").alias("trade_count"), F.min("total_return").alias("_w"),
    )
    return out.withColumn("error", F.when(F.col("_w") <= -1, "a segment lost all, nothing left to compound")).drop("_w")


def account_vs_benchmark(account: DataFrame, benchmark: DataFrame, start: str) -> DataFrame:
    """(date, value) of both on days that both have from ``start`` on, positive only: returns, difference, drawdowns (negative); one row."""
    ok = lambda df, n: df.filter((F.col("date") >= F.lit(start).cast("date")) & (F.col("value") > 0)).select("date", F.col("value").alias(n))
    both = ok(account, "a").join(ok(benchmark, "b"), "date")
    peaks = {"_pa": ("max", F.col("a")), "_pb": ("max", F.col("b"))}
    both = scans.running(both, [], "date", scans.time_block("date", "1 day", 1_000), peaks)
    both = both.withColumns({"_da": F.col("a") / F.col("_pa") - 1, "_db": F.col("b") / F.col("_pb") - 1})
    ends = lambda c: F.max_by(c, "date") / F.min_by(c, "date") - 1
    out = both.agg(F.count("*").alias("trading_days"), F.min("date").alias("start"), F.max("date").alias("end"), ends("a").alias("account_return"), ends("b").alias("benchmark_return"), F.min("_da").alias("account_max_drawdown"), F.min("_db").alias("benchmark_max_drawdown"))
    enough = F.col("trading_days") >= 2
    out = out.select("trading_days", F.when(enough, "ok").otherwise("not enough data yet").alias("status"), *[F.when(enough, F.col(c)).alias(c) for c in out.columns[1:]])
    return out.withColumn("difference", F.col("account_return") - F.col("benchmark_return"))


def validate_metrics_input(eq: DataFrame, keys: list[str], by: str = "bar_idx", universe: DataFrame | None = None) -> DataFrame:
    """Per keys the first ``error`` of an equity curve, null if none: no values, positions for some of them only, a position outside
    0 to 1, a first value of zero or less. Curves without values are those of ``universe`` (keys) that ``eq`` doesn't have.
    """
    inside = F.min(F.coalesce(F.col("position").between(0, 1), F.lit(True)))
    out = eq.groupBy(*keys).agg(F.min_by("equity", by).alias("_e"), inside.alias("_p"), F.count("position").alias("_given"), F.count("*").alias("_n"))
    if universe is not None:
        out = universe.select(*keys).distinct().join(out, keys, "left")
    error: Column = F.when(F.col("_n").isNull(), "no equity").when((F.col("_given") > 0) & (F.col("_given") < F.col("_n")), "positions are incomplete").when(~F.col("_p"), "a position is outside 0 to 1").when(F.col("_e") <= 0, "equity starts at zero or less")
    return out.select(*keys, error.alias("error"))

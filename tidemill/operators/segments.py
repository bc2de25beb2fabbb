"""Gap-free segments of bars, and what depends on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scans
from .intervals import in_intervals


def ordered():  # noqa: ANN201
    """Rows of one segment in order. All indicators share it, so stacked windows need one shuffle and sort."""
    return Window.partitionBy("symbol", "segment_id").orderBy("bar_idx")


def frame(first: int | None, last: int | None):  # noqa: ANN201
    """Rows of the segment from ``first`` to ``last`` relative to the current one; None: unbounded."""
    return ordered().rowsBetween(Window.unboundedPreceding if first is None else first, Window.unboundedFollowing if last is None else last)


def continuous_segments(bars: DataFrame, step: str, breaks: DataFrame | None = None, block: int | None = None) -> DataFrame:
    """``bars`` without those in ``breaks``, with ``segment_id`` (from 0 by symbol) and ``bar_idx`` (from 0 by segment).

    A segment ends where the next bar is not exactly one ``step`` (an interval text) later. Gaps are never filled. Bars are
    numbered in blocks of about ``block`` of them (``scans.BLOCK``), so a symbol is many tasks.
    """
    if breaks is not None:
        bars = outside_intervals(bars, breaks)
    return scans.number_runs(bars, ["symbol"], "ts", scans.time_block("ts", step, block), f"ts = prev_ts + interval {step}", ["ts"], "segment_id", "bar_idx")


def outside_intervals(df: DataFrame, intervals: DataFrame) -> DataFrame:
    """Rows whose ``ts`` lies in no half-open interval (start, end), of their symbol where intervals have one."""
    return in_intervals(df, intervals, "_in").filter("not _in").drop("_in")


def inside_intervals(df: DataFrame, intervals: DataFrame) -> DataFrame:
    """Rows whose ``ts`` lies in an interval: membership in certified segments."""
    return in_intervals(df, intervals, "_in").filter("_in").drop("_in")


#: Fixed value: why a trade has to end at a continuity break.
BOUNDARY = "DATA_BOUNDARY_TERMINATION"


def boundary_termination(df: DataFrame, breaks: DataFrame) -> DataFrame:
    """``df`` with ``termination``: why a trade open at that time has to end there, null outside breaks."""
    return in_intervals(df, breaks, "_in").withColumn("termination", F.when(F.col("_in"), BOUNDARY)).drop("_in")


def split_series(bars: DataFrame, breaks: DataFrame, step: str = "1 hour", block: int | None = None) -> DataFrame:
    """``bars`` outside ``breaks`` with ``series_id`` (from 0): a new one wherever blocked bars lie between; steps don't matter. ``step`` is how far bars are apart as a rule."""
    marked = in_intervals(bars, breaks, "_in")
    cut = scans.time_block("ts", step, block)
    marked = scans.running(marked, ["symbol"], "ts", cut, {"_blocked": ("sum", F.col("_in").cast("int"))}).filter("not _in").drop("_in")
    return scans.number_runs(marked, ["symbol"], "ts", cut, "_blocked = prev__blocked", ["_blocked"], "series_id", "_place").drop("_blocked", "_place")


def lookback_eligible(seg: DataFrame, n: int, start: str | None = None, step: str = "1 hour") -> DataFrame:
    """``seg`` with ``eligible``: ``n`` bars without a gap end here, the first not before ``start``."""
    if n <= 0:
        raise ValueError("the lookback must be positive")
    ok = F.col("bar_idx") >= n - 1
    if start:
        ok = ok & (F.col("ts") - F.expr(f"{n - 1} * interval {step}") >= F.lit(start).cast("timestamp_ntz"))
    return seg.withColumn("eligible", ok)


def return_eligible(seg: DataFrame) -> DataFrame:
    """``seg`` with ``eligible``: the bar before is one step earlier and neither is in a break."""
    return seg.withColumn("eligible", F.col("bar_idx") > 0)


def synchronized_segments(lead: DataFrame, target: DataFrame, step: str, breaks: DataFrame | None = None) -> DataFrame:
    """Pairs of bars of equal times, segmented anew: columns of ``target`` and ``lead_close``; ``symbol`` is the target's."""
    if breaks is not None:
        lead, target = outside_intervals(lead, breaks), outside_intervals(target, breaks)
    joined = target.join(lead.select("ts", F.col("close").alias("lead_close")), "ts")
    return continuous_segments(joined, step)


def min_length(seg: DataFrame, n: int) -> DataFrame:
    """Rows of segments with at least ``n`` bars."""
    long = seg.filter(F.col("bar_idx") == n - 1).select("symbol", "segment_id")
    return seg.join(long, ["symbol", "segment_id"], "left_semi")

"""From signals to non-overlapping events, returns and outcomes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import net_return
from ..sources.store import written
from . import scans
from .indicators import positions
from .scans import over_blocks
from .segments import frame, ordered

# Fee and slippage of the registered cost cases, and the execution delays in bars.
COST_CASES = (("baseline", 0.001, 0.0005), ("stress_1", 0.0015, 0.001), ("stress_2", 0.0025, 0.0015))
DELAYS = (1, 2)


def stress_grid(spark: SparkSession, costs: tuple = COST_CASES, delays: tuple[int, ...] = DELAYS) -> DataFrame:
    """All cost cases by delays: ``cost``, ``fee``, ``slip``, ``delay``."""
    table = spark.createDataFrame([(n, float(f), float(s)) for n, f, s in costs], "cost string, fee double, slip double")
    return table.crossJoin(spark.createDataFrame([(int(d),) for d in delays], "delay int"))


def _pointers(at: np.ndarray, space: np.ndarray) -> np.ndarray:
    """For each candidate of a block the next one that may be taken after it, or their number."""
    n = len(at)
    if not n or (space == space[0]).all():
        return np.searchsorted(at, at + space[0]) if n else np.empty(0, np.int64)
    out, far = np.full(n, n), int(space.max())
    for j in range(n):
        later = np.searchsorted(at, at[j] + far)
        own = np.flatnonzero(at[j + 1 : later + 1] - at[j] >= space[j + 1 : later + 1])
        out[j] = j + 1 + own[0] if len(own) else n
    return out


def _first(at: np.ndarray, space: np.ndarray, last: int | None) -> int:
    """The first candidate that may be taken after bar ``last``, or their number."""
    ok = np.flatnonzero(at - last >= space) if last is not None else np.arange(min(1, len(at)))
    return int(ok[0]) if len(ok) else len(at)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches as one table per run of equal ``keys``."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        place = list(zip(*[batch.column(k).to_pylist() for k in keys]))
        cuts = [0, *[k for k in range(1, len(place)) if place[k] != place[k - 1]], len(place)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if held and place[a] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = place[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def select_non_overlapping(candidates: DataFrame, keys: list[str], spacing: str | Column = "spacing", block: int | None = None) -> DataFrame:
    """Of ``candidates`` (``keys`` and bar_idx), those that a first-come walk takes: each at least ``spacing`` bars after the last taken. Repeated candidates count once.

    Bars are cut in blocks, which are tasks. All that a block needs of the bars before is the last one taken. So every block
    first tells, for each candidate that it may begin with, the last bar that is taken then (pointers to the next candidate
    are doubled until they reach the end); a fold over one row per block finds where each begins; the blocks then follow
    their pointers. A task holds one block of one key.
    """
    space = F.col(spacing) if isinstance(spacing, str) else spacing
    size = block or scans.BLOCK
    named = candidates.select(*keys, "bar_idx", space.cast("bigint").alias("_space")).withColumn("_block", F.floor(F.col("bar_idx") / size)).dropDuplicates([*keys, "bar_idx"])
    named = written(named, "candidates")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.select(*keys).schema)
    places = [*keys, "_block"]
    low, high = named.agg(F.min("_block"), F.max("_block")).first()

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, places):
            at, space = group["bar_idx"].to_numpy(), group["_space"].to_numpy()
            begin = int(group["_block"][0].as_py()) * size
            # the first candidates, up to one that no bar before the block can keep from being taken
            free = np.flatnonzero(at - (begin - 1) >= space)
            heads = int(free[0]) + 1 if len(free) else len(at)
            final, step = np.arange(len(at) + 1), np.append(_pointers(at, space), len(at))
            while (step[:heads] < len(at)).any():
                final = np.where(step < len(at), final[step], final)
                step = step[step]
            row = [[at[:heads].tolist()], [space[:heads].tolist()], [at[final[:heads]].tolist()]]
            yield pa.RecordBatch.from_arrays([*[group[c].slice(0, 1).combine_chunks() for c in places], *[pa.array(r, pa.list_(pa.int64())) for r in row]], names=[*places, "heads", "spaces", "ends"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            before = []
            columns = [batch.column(c).to_pylist() for c in ("heads", "spaces", "ends")]
            for own, heads, spaces, final in zip(zip(*[batch.column(k).to_pylist() for k in keys]), *columns):
                if own != now:
                    now, last = own, None
                before.append(last)
                j = _first(np.array(heads), np.array(spaces), last)
                last = final[j] if j < len(heads) else last
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in places], pa.array(before, pa.int64())], names=[*places, "_last"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, places):
            at, space = group["bar_idx"].to_numpy(), group["_space"].to_numpy()
            following, taken = _pointers(at, space).tolist(), []
            j = _first(at, space, group["_last"][0].as_py())
            while j < len(at):
                taken.append(j)
                j = following[j]
            yield from group.select([*keys, "bar_idx"]).take(pa.array(taken, pa.int64())).combine_chunks().to_batches()

    def dealt(df: DataFrame, by: list[str], *order: str) -> DataFrame:
        return df.withColumn("_walk", F.xxhash64(*by)).repartition("_walk").sortWithinPartitions("_walk", *by, *order).drop("_walk")

    start = named.withColumn("_last", F.lit(None).cast("bigint"))
    if low != high:
        rows = dealt(named, places, "bar_idx").mapInArrow(ends, f"{kinds}, _block bigint, heads array<bigint>, spaces array<bigint>, ends array<bigint>")
        carried = dealt(rows, keys, "_block").mapInArrow(fold, f"{kinds}, _block bigint, _last bigint")
        start = named.join(carried, places)
    return dealt(start, places, "bar_idx").mapInArrow(walk, f"{kinds}, bar_idx bigint")


def attach_entry_exit(events: DataFrame, seg: DataFrame, delay: str = "delay", hold: str = "hold") -> DataFrame:
    """``events`` with entry and exit bars and prices; those whose exit lies beyond the segment drop out."""
    keys = ["symbol", "segment_id"]
    df = events.withColumns({"entry_idx": F.col("bar_idx") + F.col(delay), "exit_idx": F.col("bar_idx") + F.col(delay) + F.col(hold) - 1})
    bars = seg.select(*keys, F.col("bar_idx").alias("_i"), F.col("open").alias("entry_open"), F.col("ts").alias("entry_ts"))
    ends = seg.select(*keys, F.col("bar_idx").alias("_j"), F.col("close").alias("exit_close"), F.col("ts").alias("exit_ts"))
    df = df.join(bars.withColumnRenamed("_i", "entry_idx"), [*keys, "entry_idx"])
    return df.join(ends.withColumnRenamed("_j", "exit_idx"), [*keys, "exit_idx"])


def run_events(hits: DataFrame, seg: DataFrame, stress: DataFrame, hold: str | None = None) -> DataFrame:
    """Events and net returns of all cells under all cost cases and delays.

    ``hits`` are the bars where cells fire. An event takes delay + hold bars: the parameter ``hold``, or a column ``hold`` of the hits,
    or 1; signals meanwhile are passed over; where an exit would lie beyond the segment there is no event.
    """
    held = F.col("params")[hold].cast("int") if hold else F.col("hold") if "hold" in hits.columns else F.lit(1)
    delays = stress.select("delay").distinct()
    df = hits.withColumn("hold", held).join(F.broadcast(delays))
    last = seg.groupBy("symbol", "segment_id").agg(F.max("bar_idx").alias("_last"))
    df = df.join(last, ["symbol", "segment_id"]).filter(F.col("bar_idx") + F.col("delay") + F.col("hold") - 1 <= F.col("_last"))
    keys = ["cell", "symbol", "segment_id", "delay", "hold"]
    taken = select_non_overlapping(df, keys, F.col("delay") + F.col("hold"))
    priced = attach_entry_exit(taken, seg).join(F.broadcast(stress), "delay")
    return priced.withColumn("ret", net_return(F.col("entry_open"), F.col("exit_close"), F.col("fee"), F.col("slip")))


def event_equity(events: DataFrame, keys: list[str], order: str = "bar_idx") -> DataFrame:
    """``events`` with ``equity``: the running product of 1 + ret by ``keys``, from 1. A return of -1 or less makes it 0 from there."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    growth = F.exp(F.sum(F.ln(F.when(F.col("ret") > -1, 1 + F.col("ret")))).over(w))
    dead = F.max((F.col("ret") <= -1).cast("int")).over(w) == 1
    return events.withColumn("equity", F.when(dead, F.lit(0.0)).otherwise(growth))


def compound(r: str | Column = "ret") -> Column:
    """Aggregate: product of 1 + r, less 1. A return of -1 or less gives -1; no row gives 0."""
    x = F.col(r) if isinstance(r, str) else r
    return F.when(F.max((x <= -1).cast("int")) == 1, F.lit(-1.0)).otherwise(F.coalesce(F.exp(F.sum(F.ln(F.when(x > -1, 1 + x)))), F.lit(1.0)) - 1)


def segment_benchmark(seg: DataFrame, fee: float, slip: float) -> DataFrame:
    """Per segment of two bars and more, the return of buying the first open and selling the last close."""
    ends = seg.groupBy("symbol", "segment_id").agg(F.count("*").alias("bars"), F.min_by("open", "bar_idx").alias("first_open"), F.max_by("close", "bar_idx").alias("last_close"))
    return ends.filter("bars >= 2").withColumn("ret", net_return(F.col("first_open"), F.col("last_close"), F.lit(fee), F.lit(slip)))


def eligible_benchmark(seg: DataFrame, eligible: DataFrame, fee: float, slip: float) -> DataFrame:
    """``segment_benchmark`` of the segments in ``eligible`` (symbol, segment_id) only."""
    return segment_benchmark(seg.join(eligible.select("symbol", "segment_id").distinct(), ["symbol", "segment_id"], "left_semi"), fee, slip)


def conditional_control(seg: DataFrame, condition: Column, delay: int) -> DataFrame:
    """Mean close-to-close return ``delay`` bars later: where ``condition`` holds, everywhere, and the difference."""
    later = F.lead("close", delay).over(ordered()) / F.lead("close", delay - 1).over(ordered()) - 1 if delay > 1 else F.lead("close", 1).over(ordered()) / F.col("close") - 1
    df = over_blocks(seg, lambda d: d.withColumns({"_r": later, "_c": condition}), 1_000, delay).filter("bar_idx >= 1 and _r is not null")
    hit = F.when(F.coalesce("_c", F.lit(False)), F.col("_r"))
    out = df.agg(F.count(hit).alias("conditional_events"), F.count("*").alias("control_events"), F.coalesce(F.avg(hit), F.lit(0.0)).alias("conditional_mean"), F.coalesce(F.avg("_r"), F.lit(0.0)).alias("control_mean"))
    return out.withColumn("difference", F.col("conditional_mean") - F.col("control_mean"))


def control_by_cell(seg: DataFrame, hits: DataFrame) -> DataFrame:
    """As ``conditional_control`` one bar later, with the condition of each cell where ``hits`` (symbol, segment_id, bar_idx, cell) has the bar."""
    later = F.lead("close", 1).over(ordered()) / F.col("close") - 1
    df = over_blocks(seg, lambda d: d.withColumn("_r", later), 0, 1).filter("bar_idx >= 1 and _r is not null")
    every = df.agg(F.count("*").alias("control_events"), F.coalesce(F.avg("_r"), F.lit(0.0)).alias("control_mean"))
    own = hits.select("cell", "symbol", "segment_id", "bar_idx").join(df.select("symbol", "segment_id", "bar_idx", "_r"), ["symbol", "segment_id", "bar_idx"])
    out = own.groupBy("cell").agg(F.count("*").alias("conditional_events"), F.avg("_r").alias("conditional_mean")).crossJoin(F.broadcast(every))
    return out.withColumn("difference", F.col("conditional_mean") - F.col("control_mean"))


def first_touch(triggers: DataFrame, horizon: int = 19, reward: float = 2.0, fee: float = 0.0, warm: Column | None = None, step: str = "1 hour") -> DataFrame:
    """Trades of ``short`` / ``long`` bars: stop or target, whichever the next ``horizon`` bars touch first.

    A short stops at the bar's high, a long at its low; the target is ``reward`` times the risk away. The stop
    counts first on the same bar; bars with both are short; without risk, without a touch, or within the last
    horizon + 1 bars of the symbol there is no trade. Result in multiples of the risk, less ``fee``. Bars are about ``step`` apart.
    """
    fires = F.col("short") | F.col("long")
    path = F.collect_list(F.struct("high", "low")).over(frame(1, horizon))
    ahead = lambda d: d.withColumns({"_path": F.when(fires, path), "_later": F.lead("ts", horizon + 1).over(ordered())}).filter(fires)
    df = over_blocks(positions(triggers, step), ahead, 0, horizon + 1).filter("_later is not null")
    if warm is not None:
        df = df.filter(warm)
    side = F.when(F.col("short"), "SHORT").otherwise("LONG")
    risk = F.when(F.col("short"), F.col("high") - F.col("close")).otherwise(F.col("close") - F.col("low"))
    df = df.withColumns({"side": side, "risk": risk}).filter("risk > 0")
    target = F.when(F.col("short"), F.col("close") - reward * F.col("risk")).otherwise(F.col("close") + reward * F.col("risk"))
    df = df.withColumn("target", target)
    stop = lambda b: F.when(F.col("short"), b["high"] >= F.col("high")).otherwise(b["low"] <= F.col("low"))
    hit = lambda b: F.when(F.col("short"), b["low"] <= F.col("target")).otherwise(b["high"] >= F.col("target"))
    first = F.get(F.filter("_path", lambda b: stop(b) | hit(b)), F.lit(0))
    df = df.withColumn("_first", first).filter("_first is not null")
    return df.withColumn("result", F.when(stop(F.col("_first")), F.lit(-1.0)).otherwise(F.lit(reward)) - fee).drop("_path", "_first", "_later", "segment_id", "bar_idx")


def bracket_summary(trades: DataFrame) -> DataFrame:
    """Trades, wins, win rate in percent, net result."""
    out = trades.agg(F.count("*").alias("trades"), F.count_if(F.col("result") > 0).alias("wins"), F.coalesce(F.sum("result"), F.lit(0.0)).alias("net"))
    return out.withColumn("win_rate", F.try_divide(100.0 * F.col("wins"), F.col("trades")))


def last_trades(trades: DataFrame, n: int = 5) -> DataFrame:
    """The latest n trades."""
    return trades.orderBy(F.col("ts").desc(), "symbol").limit(n)

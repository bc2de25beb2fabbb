"""Hypotheses decided from raw rows on: treated bars, events of all cells, the battery, a record of each decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import archives
from ..sources.store import written
from . import event_study, indicators, intervals, quality, robustness, scans, segments, signals

#: Cells of the hypothesis at place k are numbered from k times this.
SPAN = 1_000
_DECIDED = ("hypothesis", "failed", "required", "passed", "decision")


def treated_bars(rows: DataFrame, end: str, step: str = "1 hour") -> tuple[DataFrame, DataFrame]:
    """(bars, breaks) of normalised rows: valid bars outside breaks, and the restored regions around all events before ``end``.

    Nothing is repaired. Rows whose time can't be read have no bar and break nothing; they stay in the scan's events.
    """
    rows = written(rows, "rows")
    valid = written(quality.valid_timestamps(rows), "valid")
    hours = written(intervals.affected_hours(intervals.event_id(quality.scan_quality(rows)), end), "hours")
    clean = intervals.clean_hours(valid, hours, end)
    breaks = written(intervals.restore_regions(intervals.coalesce_regions(hours, step), clean, step), "breaks")
    bars = quality.keep_valid(rows, valid).select("symbol", "ts", *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")])
    return written(segments.outside_intervals(bars, breaks), "bars"), breaks


def _decided(dims: DataFrame, bases: DataFrame) -> DataFrame:
    return robustness.decide(dims, ["cell"]).join(bases, "cell").select(*_DECIDED)


def decide_hypotheses(seg: DataFrame, names: tuple[str, ...], nine: bool = False) -> DataFrame:
    """A decision of each hypothesis on single bars of ``seg`` (which is read often: write it), every symbol of it required.

    All registered cells run under all costs and delays, each as long as it holds; the battery judges the registered base,
    with the hypothesis' other cells as its neighbours. Rows: hypothesis, failed (dimensions), required, passed, decision.
    """
    spark = seg.sparkSession
    number = {n: SPAN * k for k, n in enumerate(names)}
    from_ = F.create_map(*[F.lit(x) for pair in number.items() for x in pair])
    hits = signals.evaluate_grids(seg, names).withColumn("cell", from_[F.col("hypothesis")] + F.col("cell"))
    events = written(event_study.run_events(hits, seg, event_study.stress_grid(spark)), "events")
    bases = spark.createDataFrame([(n, number[n] + signals.base_cell(n)) for n in names], "hypothesis string, cell bigint")
    return _decided(robustness.battery(events, seg, bases, nine, family=F.floor(F.col("cell") / SPAN)), bases)


def decide_pair(pair: DataFrame, name: str = "hyp0006") -> DataFrame:
    """The decision of a hypothesis on ``pair`` (synchronised segments with ``lead_ret``; written): only the target is required.

    Instead of a second symbol, transfer asks that bars after a signal gain more on average than all bars do.
    """
    spark = pair.sparkSession
    hits = written(signals.evaluate_grid(pair, name), "hits")
    events = written(event_study.run_events(hits, pair, event_study.stress_grid(spark)), "events")
    control = event_study.control_by_cell(pair, hits).crossJoin(pair.select("symbol").distinct())
    bases = spark.createDataFrame([(name, signals.base_cell(name))], "hypothesis string, cell bigint")
    return _decided(robustness.battery(events, pair, bases, control=control), bases)


def cycle_decisions(decisions: DataFrame, cycles: dict[str, tuple[str, ...]], candidate: tuple[str, ...] = ()) -> DataFrame:
    """``decisions`` with their ``cycle``, and a row 'overall' for each: all hypotheses have to pass, or one in a ``candidate`` cycle.

    A hypothesis without a decision fails its cycle. ``failed`` of an overall row names hypotheses in order.
    """
    spark = decisions.sparkSession
    of = spark.createDataFrame([(c, n, c in candidate) for c, names in cycles.items() for n in names], "cycle string, hypothesis string, one boolean")
    every = of.join(decisions, "hypothesis", "left")
    ok = F.coalesce(F.col("decision") == "PASS", F.lit(False))
    sums = every.groupBy("cycle", "one").agg(F.sort_array(F.collect_list(F.when(~ok, F.col("hypothesis")))).alias("failed"), F.count("*").cast("int").alias("_n"), F.count_if(ok).cast("int").alias("passed"))
    required = F.when(F.col("one"), F.lit(1)).otherwise(F.col("_n"))
    total = sums.select("cycle", F.lit("overall").alias("hypothesis"), "failed", required.alias("required"), "passed", F.when(F.col("passed") >= required, "PASS").otherwise("FAIL").alias("decision"))
    return every.select("cycle", *_DECIDED).unionByName(total)


def run_cycles(rows: DataFrame, end: str, lead: str, target: str, cycles: dict[str, tuple[str, ...]], step: str = "1 hour") -> DataFrame:
    """From normalised raw rows to the decisions of all ``cycles``: treatment, segments, grids, events, battery.

    Cycles whose hypotheses hold longer than a bar are judged by nine dimensions and need one candidate, the others by eight and
    need all. ``hyp0006`` runs on ``target`` with ``lead`` ahead, all others on every symbol of ``rows``.
    """
    bars, _ = treated_bars(rows, end, step)
    seg = written(segments.continuous_segments(bars, step), "segments")
    names = [n for group in cycles.values() for n in group]
    single = tuple(n for n in names if n != "hyp0006" and not signals.SIGNALS[n].hold)
    held = tuple(n for n in names if signals.SIGNALS[n].hold)
    parts = [decide_hypotheses(seg, single)] if single else []
    parts += [decide_hypotheses(seg, held, nine=True)] if held else []
    if "hyp0006" in names:
        pair = segments.synchronized_segments(bars.filter(F.col("symbol") == lead), bars.filter(F.col("symbol") == target), step)
        parts.append(decide_pair(written(scans.over_blocks(pair, lambda d: d.withColumn("lead_ret", indicators.ret(1, "lead_close")), 1), "pairs")))
    decisions = parts[0]
    for more in parts[1:]:
        decisions = decisions.unionByName(more)
    return cycle_decisions(decisions, cycles, tuple(c for c, group in cycles.items() if any(n in held for n in group)))


def commit_decisions(decisions: DataFrame, path: str, version: str, fee: float = 0.001, slip: float = 0.0005) -> int:
    """Decisions as immutable records named by version, cycle and hypothesis; see ``archives.commit_experiments``."""
    name = F.concat_ws("/", F.lit(version), "cycle", "hypothesis").alias("experiment_id")
    return archives.commit_experiments(decisions.select(name, "cycle", *_DECIDED, F.lit(fee).alias("fee"), F.lit(slip).alias("slip")), path)

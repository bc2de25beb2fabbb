"""Robustness dimensions of hypotheses and the decision over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written
from . import metrics
from .event_study import compound, event_equity
from .indicators import regime
from .scans import over_blocks


def param_neighborhood(summary: DataFrame, keys: list[str], share: float = 0.6, variant: str = "median") -> DataFrame:
    """Over a hypothesis' cells: shares with positive mean segment return and compound return, the median compound.

    'median' asks for the first share and a positive median, 'both' for both shares.
    """
    pos = lambda c: F.avg((F.col(c) > 0).cast("double"))
    out = summary.groupBy(*keys).agg(F.count("*").alias("valid_cells"), pos("mean_segment_return").alias("positive_fraction"), pos("compound_return").alias("positive_compound_fraction"), F.percentile("compound_return", F.lit(0.5)).alias("median_compound_return"))
    ok = (F.col("positive_fraction") >= share) & ((F.col("median_compound_return") > 0) if variant == "median" else (F.col("positive_compound_fraction") >= share))
    return out.withColumn("pass", ok)


def stress_pass(summary: DataFrame, keys: list[str], cost: str, delay: int) -> DataFrame:
    """Whether the cell under one cost case and delay has positive mean segment and compound returns."""
    ok = (F.col("mean_segment_return") > 0) & (F.col("compound_return") > 0)
    return summary.filter((F.col("cost") == cost) & (F.col("delay") == delay)).select(*keys, ok.alias("pass"))


def cost_stress(summary: DataFrame, keys: list[str], cost: str = "stress_2") -> DataFrame:
    return stress_pass(summary, keys, cost, 1)


def timing_stress(summary: DataFrame, keys: list[str], cost: str = "baseline") -> DataFrame:
    return stress_pass(summary, keys, cost, 2)


def regime_events(events: DataFrame, seg: DataFrame, keys: list[str], least: int = 100, variant: str = "bars", k: int = 168, up: float = 0.1, down: float = -0.1) -> DataFrame:
    """Per keys whether events are positive in their regimes at the signal.

    'bars' counts regimes with ``least`` labelled bars and passes with fewer than two of them or two positive ones;
    'strict' counts regimes with ``least`` events and needs two, both positive.
    """
    labelled = over_blocks(seg, lambda d: d.withColumn("regime", regime(k, up, down)), k).filter("regime is not null")
    bars = labelled.groupBy("symbol", "regime").agg(F.count("*").alias("bars"))
    own = events.join(labelled.select("symbol", "segment_id", "bar_idx", "regime"), ["symbol", "segment_id", "bar_idx"])
    got = own.groupBy(*keys, "regime").agg(F.count("*").alias("events"), compound().alias("compound_return"))
    every = events.select(*keys).distinct().join(bars, "symbol").join(got, [*keys, "regime"], "left")
    counts = F.col("bars") >= least if variant == "bars" else F.coalesce("events", F.lit(0)) >= least
    out = every.groupBy(*keys).agg(F.count_if(counts).alias("qualifying"), F.count_if(counts & (F.coalesce("compound_return", F.lit(0.0)) > 0)).alias("positive"))
    ok = (F.col("positive") >= 2) | ((F.col("qualifying") < 2) if variant == "bars" else F.lit(False))
    return out.withColumn("pass", ok)


def regime_equity(curve: DataFrame, keys: list[str], k: int = 168, up: float = 0.1, down: float = -0.1) -> DataFrame:
    """Per keys and regime: bars and compound change of equity on bars of that regime."""
    w = Window.partitionBy(*keys, "segment_id").orderBy("bar_idx")
    move = F.col("close") / F.lag("close", k).over(w) - 1
    label = F.when(move > up, "bull").when(move < down, "bear").when(move.isNotNull(), "neutral")
    df = curve.withColumns({"regime": label, "ret": F.col("equity") / F.lag("equity").over(w) - 1}).filter("regime is not null and ret is not null")
    return df.groupBy(*keys, "regime").agg(F.count("*").alias("bars"), compound().alias("return"))


def leave_one_out(segs: DataFrame, keys: list[str], seg: DataFrame | None = None, share: float = 0.75) -> DataFrame:
    """Share of segments without which the rest still gains, its minimum, and whether it passes.

    One pass: the rest's log return is the total less the segment's. With ``seg`` (symbol, segment_id), segments
    without events count too.
    """
    lr = F.ln(F.greatest(1 + F.col("segment_return"), F.lit(1e-300)))
    if seg is not None:
        every = segs.select(*keys).distinct().join(seg.select("symbol", "segment_id").distinct(), "symbol")
        segs = every.join(segs, [*keys, "segment_id"], "left").na.fill(0.0, ["segment_return"])
    total = F.sum("_l").over(Window.partitionBy(*keys))
    df = segs.withColumn("_l", lr).withColumn("_rest", F.exp(total - F.col("_l")) - 1)
    out = df.groupBy(*keys).agg(F.count("*").alias("variants"), F.avg((F.col("_rest") > 1e-12).cast("double")).alias("pass_fraction"), F.min("_rest").alias("_min"))
    return out.withColumns({"minimum": F.when(F.col("variants") >= 2, F.col("_min")), "pass": F.col("pass_fraction") >= share}).drop("_min")


def loo_min(segs: DataFrame, keys: list[str]) -> DataFrame:
    """The least compound return without one segment; null with fewer than two."""
    return leave_one_out(segs, keys).select(*keys, "minimum")


def log_concentration(segs: DataFrame, keys: list[str]) -> DataFrame:
    """The largest share that one segment has of all positive log returns; null without any."""
    gain = F.when(F.col("segment_return") > 0, F.ln(1 + F.col("segment_return")))
    return segs.groupBy(*keys).agg(F.when(F.sum(gain) > 0, F.max(gain) / F.sum(gain)).alias("max_share"))


def top_share(events: DataFrame, keys: list[str], variant: str = "ceil", value: str = "ret") -> DataFrame:
    """What the top tenth of results has of all positive ones.

    The tenth is of the positive results ('ceil', and 'tenth', which rounds up in whole numbers) or of all ('all').
    """
    order = Window.partitionBy(*keys).orderBy(F.col(value).desc())
    df = events.filter(F.col(value) > 0) if variant != "all" else events
    n = F.count("*").over(Window.partitionBy(*keys))
    top = F.greatest(F.lit(1), F.ceil(n * 0.1)) if variant == "ceil" else F.greatest(F.lit(1), F.floor((n + 9) / 10)) if variant == "tenth" else F.ceil(n * 0.1)
    df = df.withColumns({"_r": F.row_number().over(order), "_top": top})
    gain = F.greatest(F.col(value), F.lit(0.0))
    return df.groupBy(*keys).agg(F.when(F.sum(gain) > 0, F.sum(F.when(F.col("_r") <= F.col("_top"), gain)) / F.sum(gain)).alias("top_share"))


def drawdown_gate(dd: DataFrame, variant: str = "loose") -> DataFrame:
    """``dd`` (max_drawdown, worst_segment_return, recovery, duration, events) with ``pass``; without events it fails. 'strict' also refuses a worst segment of exactly -50 %."""
    worst = F.col("worst_segment_return") >= -0.5 if variant == "loose" else F.col("worst_segment_return") > -0.5
    return dd.withColumn("pass", (F.col("events") > 0) & (F.col("max_drawdown") < 0.7) & worst & (F.col("recovery") <= 0.5 * F.col("duration")))


def drawdown_recovery(events: DataFrame, seg: DataFrame, keys: list[str], variant: str = "entry") -> DataFrame:
    """Per keys: events, largest drawdown of a segment's event equity, worst segment (0 at best), longest recovery and eligible duration in hours.

    'entry' dates equity by entries and spans segments from first to last bar; 'exit' dates it by exits, adds the time
    from the last peak to the segment's end where equity ends below it, and counts bars as hours.
    """
    by = [*keys, "segment_id"]
    equity = event_equity(events, by)
    fall = metrics.max_drawdown(equity, by, start=1.0).groupBy(*keys).agg(F.max("max_drawdown").alias("max_drawdown"))
    last = seg.groupBy("symbol", "segment_id").agg(F.min("ts").alias("_first"), F.max("ts").alias("end_ts"), F.count("*").alias("_bars"))
    tail = events.select(*by).distinct().join(last, ["symbol", "segment_id"]).select(*by, "end_ts") if variant == "exit" else None
    hours = metrics.longest_recovery_hours(equity, by, f"{variant}_ts", tail).groupBy(*keys).agg(F.max("longest_recovery_hours").alias("recovery"))
    worst = metrics.segment_returns(events, keys).groupBy(*keys).agg(F.least(F.min("segment_return"), F.lit(0.0)).alias("worst_segment_return"), F.sum("events").alias("events"))
    span = F.floor((F.unix_seconds(F.to_timestamp("end_ts")) - F.unix_seconds(F.to_timestamp("_first"))) / 3600) + 1
    duration = last.groupBy("symbol").agg(F.sum(span if variant == "entry" else F.col("_bars")).alias("duration"))
    return fall.join(worst, keys).join(hours, keys).join(duration, "symbol").select(*keys, "events", "max_drawdown", "worst_segment_return", "recovery", "duration")


def concentration_drawdown(segs: DataFrame, events: DataFrame, keys: list[str], drawdown: DataFrame) -> DataFrame:
    """Worst segment (which may be a gain), largest share, top share and drawdown in one row."""
    worst = segs.groupBy(*keys).agg(F.min("segment_return").alias("worst_segment_return"), F.sum("events").alias("eligible_events"))
    return worst.join(log_concentration(segs, keys), keys, "left").join(top_share(events, keys), keys, "left").join(drawdown, keys, "left")


def transferability(summary: DataFrame, keys: list[str], control: DataFrame | None = None) -> DataFrame:
    """Whether every symbol has positive mean segment and compound returns; with ``control`` (keys, difference) also a positive difference."""
    ok = (F.col("mean_segment_return") > 0) & (F.col("compound_return") > 0)
    out = summary.groupBy(*keys).agg(F.count("*").alias("symbols"), F.min(ok).alias("pass"))
    if control is None:
        return out
    return out.join(control.select(*keys, "difference"), keys, "left").withColumn("pass", F.col("pass") & F.coalesce(F.col("difference") > 0, F.lit(False)))


def battery(events: DataFrame, seg: DataFrame, cells: DataFrame, nine: bool = False, base: str = "baseline", worst: str = "stress_2", family: Column | None = None, control: DataFrame | None = None) -> DataFrame:
    """Every cell as a hypothesis' base: (cell and a boolean per dimension), each over all symbols of ``seg``. See ``decide``.

    Eight dimensions: neighbourhood of all cells, costs, timing, regimes, leave-one-out with a gain, concentration,
    drawdown and recovery, transfer to every symbol. ``nine`` takes the stricter regimes and the drawdown dated by
    exits, and adds the protocol's eligibility. Of ``events`` it reads those of cost ``base`` and delay 1, but for
    costs and timing. A symbol without events fails what it has no row for.

    ``events`` may be of several hypotheses: ``family``, an expression of ``cell``, says whose cell it is, and only cells of
    one hypothesis are neighbours. ``cells`` are then the hypotheses' bases. With ``control`` (cell, symbol, difference) transfer
    asks for a positive difference to it too.
    """
    keys = ["cell", "symbol"]
    summary = written(metrics.cell_summary(events, [*keys, "cost", "delay"]), "summary")
    at = (F.col("cost") == base) & (F.col("delay") == 1)
    first, own = summary.filter(at), events.filter(at)
    segs = written(metrics.segment_returns(own, keys), "returns")
    gain = (F.col("mean_segment_return") > 0) & (F.col("compound_return") > 0)
    half = (F.col("max_share") <= 0.5) & (F.col("top_share") <= 0.5)
    fall = drawdown_gate(drawdown_recovery(own, seg, keys, "exit" if nine else "entry")).select(*keys, "pass")
    dims = {
        "fee_slippage": cost_stress(summary, keys, worst),
        "timing": timing_stress(summary, keys, base),
        "regime_stability": regime_events(own, seg, keys, 100, "strict" if nine else "bars"),
        "sample_size_stability": leave_one_out(segs, keys, seg).join(first, keys).select(*keys, (F.col("pass") & (F.col("compound_return") > 0)).alias("pass")),
        "concentration": log_concentration(segs, keys).join(top_share(own, keys, "tenth" if nine else "ceil"), keys, "left").select(*keys, half.alias("pass")),
        "drawdown_recovery": fall,
        "asset_transferability": first.select(*keys, gain.alias("pass")) if control is None else transferability(first, keys, control).select(*keys, "pass"),
    }
    if nine:
        economic = (F.col("compound_return") >= 0.1) & (F.col("mean_segment_return") > 0) & F.col("pass")
        dims["protocol_eligibility"] = first.join(fall, keys, "left").select(*keys, economic.alias("pass"))
    out = cells.select("cell").crossJoin(seg.select("symbol").distinct())
    mine = F.lit(0) if family is None else family
    around = param_neighborhood(first.withColumn("_family", mine), ["_family", "symbol"]).select("_family", "symbol", F.col("pass").alias("parameter_neighborhood"))
    out = out.withColumn("_family", mine).join(around, ["_family", "symbol"], "left").drop("_family")
    for name, df in dims.items():
        out = out.join(df.select(*keys, F.col("pass").alias(name)), keys, "left")
    names = ["parameter_neighborhood", *dims]
    out = out.groupBy("cell").agg(*[F.min(F.coalesce(n, F.lit(False))).alias(n) for n in names])
    if nine:
        support = protocol_eligibility(first, ["cell"]).select("cell", "support")
        out = out.join(support, "cell", "left").withColumn("protocol_eligibility", F.col("protocol_eligibility") & F.coalesce("support", F.lit(False))).drop("support")
    return out


def protocol_eligibility(summary: DataFrame, keys: list[str], least_return: float = 0.1, trades: int = 300, segments: int = 20) -> DataFrame:
    """Each symbol's compound and mean segment return, and support over all symbols."""
    each = (F.col("compound_return") >= least_return) & (F.col("mean_segment_return") > 0)
    out = summary.groupBy(*keys).agg(F.min(each).alias("economic"), F.sum("events").alias("trades"), F.sum("eligible_segments").alias("segments"))
    out = out.withColumn("support", (F.col("trades") >= trades) & (F.col("segments") >= segments))
    return out.withColumn("pass", F.col("economic") & F.col("support"))


def decide(dimensions: DataFrame, keys: list[str]) -> DataFrame:
    """``dimensions`` (keys and a boolean column each) as one decision: how many pass, which fail, the label. Null fails."""
    names = [c for c in dimensions.columns if c not in keys]
    ok = {n: F.coalesce(F.col(n), F.lit(False)) for n in names}
    failed = F.array_compact(F.array(*[F.when(~ok[n], F.lit(n)) for n in names]))
    out = dimensions.select(*keys, failed.alias("failed"))
    out = out.withColumns({"required": F.lit(len(names)), "passed": F.lit(len(names)) - F.size("failed")})
    return out.withColumn("decision", F.when(F.size("failed") == 0, "PASS").otherwise("FAIL"))


def with_errors(cells: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Every cell, with its summary and the ``error`` that came with it, or that it has none. No cell drops out."""
    had = F.col("error") if "error" in summary.columns else F.lit(None).cast("string")
    out = cells.join(summary, keys, "left")
    return out.withColumn("error", F.coalesce(had, F.when(F.col("compound_return").isNull(), "no eligible segments")))


def segment_rows(seg: DataFrame, events: DataFrame, cells: DataFrame, keys: list[str], least: int) -> DataFrame:
    """A row per cell and segment: events and return, or the ``error`` why there is none. No segment drops out.

    A segment of under ``least`` bars is too short; one that lost everything can't be compounded with others.
    """
    size = seg.groupBy("symbol", "segment_id").agg(F.count("*").alias("bars"))
    own = metrics.segment_returns(events, keys)
    out = size.crossJoin(cells).join(own, [*keys, "segment_id"], "left")
    error = F.when(F.col("bars") < least, F.format_string("segment of %d bars, %d needed", F.col("bars"), F.lit(least))).when(F.col("segment_return") <= -1, "segment lost everything").when(F.col("events").isNull(), "no events")
    return out.select(*keys, "segment_id", "bars", F.coalesce("events", F.lit(0)).alias("events"), "segment_return", error.alias("error"))

"""Half-open intervals: affected regions, their restoration, certified segments and what two symbols share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import floor_interval
from . import scans


def _at(x: str):  # noqa: ANN202
    return F.lit(x).cast("timestamp_ntz")


def event_id(events: DataFrame) -> DataFrame:
    """``events`` with ``event_id``: SHA-256 of the row as compact JSON with sorted keys, nulls included."""
    body = F.to_json(F.struct(*sorted(events.columns)), {"ignoreNullFields": "false"})
    return events.withColumn("event_id", F.sha2(body, 256))


def affected_hours(events: DataFrame, end: str, unit: str = "hour") -> DataFrame:
    """Per symbol and hour before ``end`` the ids of its events, of events that have a time."""
    df = events.filter("parsed_timestamp is not null").withColumn("hour", floor_interval(F.col("parsed_timestamp"), unit))
    return df.filter(F.col("hour") < _at(end)).groupBy("symbol", "hour").agg(F.sort_array(F.collect_set("event_id")).alias("anomaly_ids"))


def coalesce_regions(hours: DataFrame, step: str = "1 hour") -> DataFrame:
    """Runs of consecutive hours as regions [start, end) with all their ids."""
    runs = scans.number_runs(hours, ["symbol"], "hour", scans.time_block("hour", step), f"hour = prev_hour + interval {step}", ["hour"], "_run", "_place")
    out = runs.groupBy("symbol", "_run").agg(F.min("hour").alias("start"), F.max("hour").alias("_last"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("anomaly_ids")))).alias("anomaly_ids"))
    return out.select("symbol", "start", (F.col("_last") + F.expr(f"interval {step}")).alias("end"), "anomaly_ids")


def clean_hours(valid: DataFrame, hours: DataFrame, end: str, unit: str = "hour") -> DataFrame:
    """Hours before ``end`` with a valid bar and no event."""
    ok = valid.select("symbol", floor_interval(F.col("ts"), unit).alias("hour")).distinct().filter(F.col("hour") < _at(end))
    return ok.join(hours, ["symbol", "hour"], "left_anti")


def restore_regions(regions: DataFrame, clean: DataFrame, step: str = "1 hour") -> DataFrame:
    """Regions that end where two consecutive clean hours begin, at or after their own end; unchanged where none do.

    Region ends and the first hours of clean pairs are put in one order; each region looks for the next pair.
    """
    one = F.expr(f"interval {step}")
    pair = F.lead("hour").over(Window.partitionBy("symbol").orderBy("hour")) == F.col("hour") + one
    pairs = clean.withColumn("_p", pair).filter("_p").select("symbol", F.col("hour").alias("at"), F.lit(1).alias("kind"), F.col("hour").alias("found"), F.lit(None).cast("timestamp_ntz").alias("start"), F.lit(None).cast("array<string>").alias("anomaly_ids"))
    ends = regions.select("symbol", F.col("end").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("timestamp_ntz").alias("found"), "start", "anomaly_ids")
    ahead = Window.partitionBy("symbol").orderBy(F.col("at").desc(), F.col("kind").desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = ends.unionByName(pairs).withColumn("_next", F.last("found", ignorenulls=True).over(ahead))
    return both.filter("kind = 0").select("symbol", "start", F.coalesce("_next", "at").alias("end"), "anomaly_ids")


def certified_segments(regions: DataFrame, symbols: DataFrame, start: str, end: str) -> DataFrame:
    """What regions leave of [start, end), per symbol of ``symbols``; regions may overlap."""
    inside = regions.filter((F.col("end") > _at(start)) & (F.col("start") < _at(end)))
    inside = inside.select("symbol", F.greatest("start", _at(start)).alias("rs"), F.least("end", _at(end)).alias("re"))
    edge = symbols.select("symbol", _at(end).alias("rs"), _at(end).alias("re"))
    before = Window.partitionBy("symbol").orderBy("rs", "re").rowsBetween(Window.unboundedPreceding, -1)
    df = inside.unionByName(edge).withColumn("cursor", F.coalesce(F.max("re").over(before), _at(start)))
    return df.filter("cursor < rs").select("symbol", F.col("cursor").alias("start"), F.col("rs").alias("end"))


def clip_regions(regions: DataFrame, start: str, end: str) -> DataFrame:
    """Regions cut to [start, end), with their ids; empty ones go."""
    df = regions.select("symbol", F.greatest("start", _at(start)).alias("start"), F.least("end", _at(end)).alias("end"), "anomaly_ids")
    return df.filter("start < end")


def certification(events: DataFrame, regions: DataFrame, symbols: DataFrame, partitions: DataFrame) -> DataFrame:
    """A label per symbol and partition (name, start, end): UNVERIFIED, UNUSABLE, VALID WITH DOCUMENTED EXCLUSIONS or VALID.

    A failed checksum leaves a symbol unverified, an event without a time (other than that) unusable, and a region
    that meets the partition documents an exclusion.
    """
    bad = events.groupBy("symbol").agg(F.max(F.col("anomaly_type") == "CHECKSUM_FAILURE").alias("failed"), F.max(F.col("parsed_timestamp").isNull() & (F.col("anomaly_type") != "CHECKSUM_FAILURE")).alias("lost"))
    cells = symbols.select("symbol").distinct().crossJoin(F.broadcast(partitions))
    hit = cells.alias("c").join(regions.alias("r"), (F.col("c.symbol") == F.col("r.symbol")) & (F.col("r.start") < F.col("c.end")) & (F.col("c.start") < F.col("r.end")), "left_semi").select("symbol", "name", F.lit(True).alias("cut"))
    df = cells.join(bad, "symbol", "left").join(hit, ["symbol", "name"], "left")
    label = F.when(F.col("failed"), "UNVERIFIED").when(F.col("lost"), "UNUSABLE").when(F.col("cut"), "VALID WITH DOCUMENTED EXCLUSIONS").otherwise("VALID")
    return df.select("symbol", "name", label.alias("certification"))


def continuity_breaks(regions: DataFrame) -> DataFrame:
    return regions.select("symbol", "start", "end", "anomaly_ids", F.lit("bars on both sides of an affected region belong to different segments").alias("reason"))


def in_intervals(df: DataFrame, intervals: DataFrame, out: str, ts: str = "ts", step: str = "1 hour") -> DataFrame:
    """``df`` with ``out``: whether ``ts`` lies in a half-open interval (start, end), of its symbol where intervals have one.

    A plane sweep: starts and rows are put in one order, and a row is inside where the largest end so far is later. The
    order runs in blocks of time, whose carry is that one end, however long intervals are. Empty intervals hold nothing.
    """
    keys = ["symbol"] if "symbol" in intervals.columns else []
    names = [F.col(k).alias(f"_k_{k}") for k in keys]
    row = df.select(*names, F.col(ts).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(intervals.schema["end"].dataType).alias("_end"), F.struct(*[F.col(c) for c in df.columns]).alias("_row"))
    held = intervals.filter("start < end")
    for k in keys:
        held = held.filter(F.col(k).isNotNull())
    start = held.select(*names, F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.col("end").alias("_end"), F.lit(None).cast(row.schema["_row"].dataType).alias("_row"))
    both = row.unionByName(start).withColumn("_order", F.struct("_at", "_kind"))
    swept = scans.running(both, [f"_k_{k}" for k in keys], "_order", scans.time_block("_at", step), {"_open": ("max", F.col("_end"))})
    return swept.filter("_kind = 1").select("_row.*", F.coalesce(F.col("_open") > F.col("_at"), F.lit(False)).alias(out))


#: Levels of the hours tree: enough for all timestamps.
_LEVELS = 28


def _hour(ts: Column) -> Column:
    """Hours as a positive number that grows with ``ts``."""
    return F.datediff(ts, F.lit("0001-01-01").cast("date")).cast("bigint") * 24 + F.hour(ts)


def _nodes(df: DataFrame) -> DataFrame:
    """Intervals that aren't empty, once for each node of the hours tree that they cover: at most two a level, each hour under one of them."""
    lo, hi = _hour(F.col("start")), _hour(F.col("end") - F.expr("interval 1 microsecond")) + 1
    df = df.filter("start < end").withColumns({"_lo": lo, "_hi": hi})

    def at(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level)
        low, high = F.ceil(F.col("_lo") / size).cast("bigint"), F.floor(F.col("_hi") / size).cast("bigint")
        first = F.when((low < high) & (low % 2 == 1), F.struct(level.alias("level"), low.alias("node")))
        last = F.when((low < high) & (high % 2 == 1), F.struct(level.alias("level"), (high - 1).alias("node")))
        return F.array_compact(F.array(first, last))

    nodes = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(_LEVELS)), at)))
    return df.select("start", "end", nodes.alias("_node")).select("start", "end", "_node.level", "_node.node")


def _starts_in(points: DataFrame, intervals: DataFrame, same: bool) -> DataFrame:
    """(start, end) of both where an interval of ``points`` starts in one of ``intervals`` (at its very start only if ``same``).

    A start has one node a level above it; an interval's nodes hold each hour once. They meet by equal nodes.
    """
    level = F.sequence(F.lit(0), F.lit(_LEVELS))
    up = points.filter("start < end").select("start", "end", F.explode(level).alias("level"), _hour(F.col("start")).alias("_h"))
    up = up.select("start", "end", "level", F.floor(F.col("_h") / F.pow(F.lit(2.0), F.col("level"))).cast("bigint").alias("node"))
    p, i = up.alias("p"), _nodes(intervals).alias("i")
    later = (F.col("p.start") >= F.col("i.start")) if same else (F.col("p.start") > F.col("i.start"))
    met = p.join(i, (F.col("p.level") == F.col("i.level")) & (F.col("p.node") == F.col("i.node")) & later & (F.col("p.start") < F.col("i.end")))
    return met.select(F.col("p.start").alias("start"), F.least("p.end", "i.end").alias("end"))


def _overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two intervals that overlap, one starts in the other: rows grow with the intervals' number and the result, not with their length."""
    return _starts_in(a, b, True).union(_starts_in(b, a, False))


def common_breaks(a: DataFrame, b: DataFrame) -> DataFrame:
    """All intersections of two sets of intervals."""
    return _overlaps(a, b)


def common_intervals(a: DataFrame, b: DataFrame) -> DataFrame:
    """Intersections of two sets of intervals, those that touch joined."""
    runs = scans.number_runs(_overlaps(a, b), [], "start", scans.time_block("start", "1 hour"), "start = prev_end", ["start", "end"], "_run", "_place")
    return runs.groupBy("_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def common_certification(labels: DataFrame, common: DataFrame) -> DataFrame:
    """One label for two symbols' ``labels`` (symbol, certification) and what they have in common."""
    some = common.agg(F.count("*").alias("n"))
    agg = labels.agg(F.max(F.col("certification") == "UNVERIFIED").alias("failed"), F.min(F.col("certification") == "VALID").alias("clean"))
    label = F.when(F.col("failed"), "UNVERIFIED").when(F.col("n") == 0, "UNUSABLE").when(F.col("clean"), "VALID").otherwise("VALID WITH DOCUMENTED EXCLUSIONS")
    return agg.crossJoin(some).select(label.alias("certification"))


def common_certifications(labels: DataFrame, certified: DataFrame, partitions: DataFrame) -> DataFrame:
    """``common_certification`` of every two symbols in every partition: symbol_a, symbol_b, name, certification.

    ``labels`` are those of ``certification``, ``certified`` segments (symbol, start, end), ``partitions`` (name, start, end)
    few. Two symbols have something in common in a partition where segments of both overlap within it.
    """
    c, p = certified.alias("c"), partitions.alias("p")
    cut = c.join(p, (F.col("c.start") < F.col("p.end")) & (F.col("p.start") < F.col("c.end")))
    cut = cut.select("symbol", "name", F.greatest("c.start", "p.start").alias("start"), F.least("c.end", "p.end").alias("end"))
    meet = (F.col("a.name") == F.col("b.name")) & (F.col("a.symbol") < F.col("b.symbol"))
    over = (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    names = [F.col("a.symbol").alias("symbol_a"), F.col("b.symbol").alias("symbol_b"), F.col("a.name").alias("name")]
    common = cut.alias("a").join(cut.alias("b"), meet & over).select(*names).distinct().withColumn("_some", F.lit(True))
    both = labels.alias("a").join(labels.alias("b"), meet).select(*names, F.col("a.certification").alias("_a"), F.col("b.certification").alias("_b"))
    label = F.when((F.col("_a") == "UNVERIFIED") | (F.col("_b") == "UNVERIFIED"), "UNVERIFIED").when(F.col("_some").isNull(), "UNUSABLE").when((F.col("_a") == "VALID") & (F.col("_b") == "VALID"), "VALID").otherwise("VALID WITH DOCUMENTED EXCLUSIONS")
    return both.join(common, ["symbol_a", "symbol_b", "name"], "left").select("symbol_a", "symbol_b", "name", label.alias("certification"))

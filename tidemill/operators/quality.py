"""Raw kline rows to bars and to a table of anomaly events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bar_violation, epoch_to_ts, epoch_unit, is_aligned, parse_decimal

EVENT_COLUMNS = ("symbol", "timeframe", "archive", "member", "row_no", "raw_timestamp", "parsed_timestamp", "anomaly_type", "validation_rule", "severity", "source_provenance", "message")
VALID, DOCUMENTED, UNUSABLE = "VALID", "VALID WITH DOCUMENTED SOURCE ANOMALIES", "UNUSABLE"
_HEADERS = ("open time", "timestamp")
_NAMES = ("open", "high", "low", "close", "volume")


def normalize_klines(raw: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """``raw`` (symbol, archive, member, row_no, fields) with typed columns, checks and the canonical symbol.

    Rows are never repaired or dropped; blank rows go. ``symbols`` (symbol, canonical) is a small dimension; other
    symbols keep a null canonical name. ``unit`` and ``ts`` are null for times that can't be parsed; prices that aren't finite decimals are
    null while ``fields`` keeps the text. ``violation`` is the bar contract's first failing rule.
    """
    get = lambda i: F.get("fields", F.lit(i))
    df = raw.filter(F.exists("fields", lambda x: F.trim(x) != ""))
    df = df.withColumns({"raw_timestamp": get(0), "n_fields": F.size("fields")})
    df = df.withColumns({"is_header": F.lower(F.trim("raw_timestamp")).isin(*_HEADERS), "unit": epoch_unit(F.col("raw_timestamp")), "ts": epoch_to_ts(F.col("raw_timestamp"))})
    df = df.withColumns({n: parse_decimal(get(i + 1)) for i, n in enumerate(_NAMES)})
    typed = ~F.col("is_header") & (F.col("n_fields") >= 6)
    df = df.withColumn("aligned", F.coalesce(typed & is_aligned(F.col("ts")), F.lit(False)))
    df = df.withColumn("violation", F.when(F.col("aligned"), bar_violation(F.col("symbol"), F.col("ts"), *[F.col(n) for n in _NAMES])))
    if symbols is not None:
        df = df.join(symbols, "symbol", "left")
    return df


def _walk():  # noqa: ANN202
    return Window.partitionBy("symbol", "archive").orderBy("row_no")


def flagged(rows: DataFrame) -> DataFrame:
    """``normalize_klines`` output with ``duplicate`` and ``out_of_order``, of aligned rows within their archive.

    A duplicate is any occurrence of a time after the first; out of order is a time before that of the aligned row
    before it.
    """
    same = Window.partitionBy("symbol", "archive", "aligned", "ts").orderBy("row_no")
    before = F.last(F.when(F.col("aligned"), F.col("ts")), ignorenulls=True).over(_walk().rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumns({"duplicate": F.col("aligned") & (F.row_number().over(same) > 1), "out_of_order": F.coalesce(F.col("aligned") & (F.col("ts") < before), F.lit(False))})


def valid_timestamps(rows: DataFrame) -> DataFrame:
    """Times of aligned rows that keep the contract and aren't duplicates: symbol, archive, row_no, ts."""
    return flagged(rows).filter("aligned and violation is null and not duplicate").select("symbol", "archive", "row_no", "ts")


def _event(df: DataFrame, kind: str | Column, rule: str | Column, message: str | Column, timeframe: str, source: str) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    has = lambda c, t: (F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c)
    return df.select(
        "symbol", F.lit(timeframe).alias("timeframe"), "archive", has("member", "string"), has("row_no", "bigint"), has("raw_timestamp", "string"),
        (F.col("ts") if "ts" in df.columns else F.lit(None)).cast("timestamp_ntz").alias("parsed_timestamp"),
        lit(kind).alias("anomaly_type"), lit(rule).alias("validation_rule"), F.lit("ERROR").alias("severity"), F.lit(source).alias("source_provenance"), lit(message).alias("message"),
    )


def scan_structure(archives: DataFrame, timeframe: str = "1h", source: str = "archive") -> DataFrame:
    """Events of ``archives`` (symbol, archive, member, members): not exactly one member, or one of another symbol or name."""
    many = _event(archives.filter("members <> 1"), "SCHEMA_ERROR", "ARCHIVE_ONE_FILE", "archive does not hold exactly one file", timeframe, source)
    own = F.regexp_extract("member", r"^(.+)-[^-]+-\d{4}-\d{2}(?:-\d{2})?\.csv$", 1)
    bad = archives.filter("members = 1").withColumn("_own", own).filter("_own <> symbol")
    message = F.when(F.col("_own") == "", "file in the archive has another kind of name").otherwise("file in the archive is of another symbol")
    return many.unionByName(_event(bad, "SCHEMA_ERROR", "ARCHIVE_FILE_NAME", message, timeframe, source))


def scan_schema(rows: DataFrame, timeframe: str = "1h", source: str = "archive") -> DataFrame:
    """Header rows, rows of fewer than six fields, times that can't be parsed."""
    message = F.when(F.col("is_header"), "row of column names").when(F.col("n_fields") < 6, "fewer than six fields").otherwise("time is not a whole epoch number")
    return _event(rows.filter("is_header or n_fields < 6 or ts is null"), "SCHEMA_ERROR", "kline row layout", message, timeframe, source)


def scan_alignment(rows: DataFrame, timeframe: str = "1h", source: str = "archive") -> DataFrame:
    """Times off the interval's boundary, as they are."""
    off = rows.filter("not is_header and n_fields >= 6 and ts is not null and not aligned")
    return _event(off, "NON_ALIGNED_TIMESTAMP", "timestamp on an interval boundary", "time lies between interval starts", timeframe, source)


def scan_duplicates(rows: DataFrame, timeframe: str = "1h", source: str = "archive") -> DataFrame:
    return _event(flagged(rows).filter("duplicate"), "DUPLICATE_TIMESTAMP", "TIME_ONCE", "time seen before in this archive", timeframe, source)


def scan_order(rows: DataFrame, timeframe: str = "1h", source: str = "archive") -> DataFrame:
    return _event(flagged(rows).filter("out_of_order"), "OUT_OF_ORDER_TIMESTAMP", "TIME_ASCENDING", "time is earlier than that of the row above", timeframe, source)


def scan_values(rows: DataFrame, timeframe: str = "1h", source: str = "archive") -> DataFrame:
    """Bar contract violations, as INVALID_VOLUME or INVALID_OHLC."""
    kind = F.when(F.col("violation").contains("volume"), "INVALID_VOLUME").otherwise("INVALID_OHLC")
    return _event(rows.filter("violation is not null"), kind, F.col("violation"), F.col("violation"), timeframe, source)


def _holes(df: DataFrame, keys: list[str], order: str, step: str) -> DataFrame:
    nxt = F.lead("ts").over(Window.partitionBy(*keys).orderBy(order))
    one = F.expr(f"interval {step}")
    gaps = df.withColumn("_next", nxt).filter(F.col("_next") > F.col("ts") + one)
    return gaps.select(*keys, F.explode(F.sequence(F.col("ts") + one, F.col("_next") - one, one)).alias("ts"))


def scan_gaps(rows: DataFrame, step: str = "1 hour", timeframe: str = "1h", source: str = "archive") -> DataFrame:
    """An event for each missing time between consecutive valid rows of an archive."""
    holes = _holes(valid_timestamps(rows), ["symbol", "archive"], "row_no", step)
    return _event(holes, "MISSING_INTERVAL", "TIME_WITHOUT_GAP", "no valid row for this time", timeframe, source)


def scan_checksums(files: DataFrame, timeframe: str = "1h", source: str = "archive") -> DataFrame:
    """Events of ``files`` (symbol, archive, verified) that failed."""
    return _event(files.filter("not coalesce(verified, false)"), "CHECKSUM_FAILURE", "published checksum", "digest differs from the published one", timeframe, source)


def scan_quality(rows: DataFrame, step: str = "1 hour", timeframe: str = "1h", source: str = "archive") -> DataFrame:
    """All row-level anomaly events of ``normalize_klines`` rows: one pass over flagged rows, and the gaps between valid ones."""
    rows = flagged(rows)
    layout = F.col("is_header") | (F.col("n_fields") < 6) | F.col("ts").isNull()
    message = F.when(F.col("is_header"), "row of column names").when(F.col("n_fields") < 6, "fewer than six fields").otherwise("time is not a whole epoch number")
    volume = F.col("violation").contains("volume")
    found = (
        (layout, F.lit("SCHEMA_ERROR"), F.lit("kline row layout"), message),
        (~layout & ~F.col("aligned"), F.lit("NON_ALIGNED_TIMESTAMP"), F.lit("timestamp on an interval boundary"), F.lit("time lies between interval starts")),
        (F.col("duplicate"), F.lit("DUPLICATE_TIMESTAMP"), F.lit("TIME_ONCE"), F.lit("time seen before in this archive")),
        (F.col("out_of_order"), F.lit("OUT_OF_ORDER_TIMESTAMP"), F.lit("TIME_ASCENDING"), F.lit("time is earlier than that of the row above")),
        (F.col("violation").isNotNull(), F.when(volume, "INVALID_VOLUME").otherwise("INVALID_OHLC"), F.col("violation"), F.col("violation")),
    )
    each = F.array_compact(F.array(*[F.when(bad, F.struct(k.alias("kind"), r.alias("rule"), m.alias("message"))) for bad, k, r, m in found]))
    own = rows.withColumn("_e", F.explode(each))
    own = _event(own, F.col("_e.kind"), F.col("_e.rule"), F.col("_e.message"), timeframe, source)
    valid = rows.filter("aligned and violation is null and not duplicate").select("symbol", "archive", "row_no", "ts")
    return own.unionByName(_event(_holes(valid, ["symbol", "archive"], "row_no", step), "MISSING_INTERVAL", "TIME_WITHOUT_GAP", "no valid row for this time", timeframe, source))


def tag_provenance(events: DataFrame, known: DataFrame) -> DataFrame:
    """``events`` with the source of a known issue: ``known`` (raw_timestamp or archive, issue), a small dimension.

    Row events match by their raw time, missing intervals by their archive.
    """
    times = known.filter("raw_timestamp is not null").select("raw_timestamp", F.col("issue").alias("_t")).distinct()
    files = known.filter("archive is not null").select("archive", F.col("issue").alias("_a")).distinct()
    df = events.join(times, "raw_timestamp", "left").join(files, "archive", "left")
    issue = F.when(F.col("anomaly_type") == "MISSING_INTERVAL", F.col("_a")).otherwise(F.col("_t"))
    return df.withColumn("source_provenance", F.coalesce(issue, F.col("source_provenance"))).select(*EVENT_COLUMNS)


def certify(events: DataFrame, prefix: str, universe: DataFrame | None = None) -> DataFrame:
    """``certification``: no events, only events whose provenance starts with ``prefix``, or others. One row for all events, or one for
    each row of ``universe`` (distinct keys that events have too, such as archives).
    """
    keys = universe.columns if universe is not None else []
    known = F.min(F.coalesce(F.col("source_provenance").startswith(prefix), F.lit(False)))
    out = events.groupBy(*keys).agg(F.count("*").alias("_n"), known.alias("_known"))
    if universe is not None:
        out = universe.join(out, keys, "left")
    label = F.when(F.coalesce("_n", F.lit(0)) == 0, VALID).when(F.col("_known"), DOCUMENTED).otherwise(UNUSABLE)
    return out.select(*keys, label.alias("certification"))


def summarize_quality(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Per symbol: rows processed, events by class, rows with any event."""
    n = rows.groupBy("symbol").agg(F.count("*").alias("rows_processed"))
    kinds = ("SCHEMA_ERROR", "NON_ALIGNED_TIMESTAMP", "DUPLICATE_TIMESTAMP", "OUT_OF_ORDER_TIMESTAMP", "INVALID_OHLC", "INVALID_VOLUME", "MISSING_INTERVAL", "CHECKSUM_FAILURE")
    counts = [F.count_if(F.col("anomaly_type") == k).alias(k.lower()) for k in kinds]
    bad = F.count_distinct(F.when(F.col("row_no").isNotNull(), F.struct("archive", "row_no"))).alias("invalid_rows")
    e = events.groupBy("symbol").agg(*counts, bad)
    return n.join(e, "symbol", "left").na.fill(0)


def mixed_units(rows: DataFrame) -> DataFrame:
    """Per symbol and archive the number of epoch units, and whether they are mixed."""
    out = rows.groupBy("symbol", "archive").agg(F.count_distinct("unit").alias("units"))
    return out.withColumn("mixed", F.col("units") > 1)


def keep_valid(bars: DataFrame, valid: DataFrame) -> DataFrame:
    """``bars`` whose (symbol, archive, ts) is valid."""
    return bars.join(valid, ["symbol", "archive", "ts"], "left_semi")


def in_window(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows with start <= ts < end."""
    return df.filter((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(end).cast("timestamp_ntz")))


def with_partition(df: DataFrame, partitions: DataFrame) -> DataFrame:
    """``df`` with the name of the research partition (name, start, end) that holds ``ts``; null outside."""
    p = F.broadcast(partitions.select(F.col("name").alias("partition"), F.col("start").alias("_s"), F.col("end").alias("_e")))
    return df.join(p, (F.col("ts") >= F.col("_s")) & (F.col("ts") < F.col("_e")), "left").drop("_s", "_e")


def validate_partitions(partitions: DataFrame, start: str, end: str) -> DataFrame:
    """Error rows (name, error): empty or reversed, not joining the one before, first or last not at the window's edge."""
    order = Window.orderBy("start", "end", "name")
    df = partitions.withColumns({"_before": F.lag("end").over(order), "_first": F.row_number().over(order) == 1, "_last": F.lead("start").over(order).isNull()})
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    error = (
        F.when(F.col("start") >= F.col("end"), "start must be before end")
        .when(F.col("_before") != F.col("start"), "partitions must be contiguous")
        .when(F.col("_first") & (F.col("start") != at(start)), "window start not covered")
        .when(F.col("_last") & (F.col("end") != at(end)), "window end not covered")
    )
    return df.select("name", error.alias("error")).filter("error is not null")


def missing_intervals(bars: DataFrame, step: str) -> DataFrame:
    """Missing times between a symbol's bars, across archives."""
    return _holes(bars.select("symbol", "ts").distinct(), ["symbol"], "ts", step)


def check_monotonic(bars: DataFrame, order: str = "row_no") -> DataFrame:
    """Per symbol whether times strictly increase in ``order``."""
    back = F.col("ts") <= F.lag("ts").over(Window.partitionBy("symbol").orderBy(order))
    return bars.withColumn("_b", back).groupBy("symbol").agg((F.count_if("_b") == 0).alias("increasing"))


def require_complete(bars: DataFrame, start: str, end: str, step: str) -> DataFrame:
    """Per symbol whether bars cover [start, end) exactly, one a step: first, last, rows, expected rows."""
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    span = F.size(F.sequence(at(start), at(end) - F.expr(f"interval {step}"), F.expr(f"interval {step}")))
    out = bars.groupBy("symbol").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_distinct("ts").alias("rows"))
    out = out.withColumn("expected", span.cast("bigint"))
    return out.withColumn("complete", (F.col("first") == at(start)) & (F.col("last") == at(end) - F.expr(f"interval {step}")) & (F.col("rows") == F.col("expected")))


def common_start(bars: DataFrame, floor: str, end: str) -> DataFrame:
    """The latest first time of all symbols, not before ``floor``; ``error`` if that is at or past ``end``."""
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    first = bars.groupBy("symbol").agg(F.min("ts").alias("first")).agg(F.greatest(F.max("first"), at(floor)).alias("common_start"))
    return first.withColumn("error", F.when(F.col("common_start") >= at(end), "no common window"))


def first_bad_row(events: DataFrame) -> DataFrame:
    """Per symbol and archive the first row whose layout or time failed, with where it is."""
    bad = events.filter("anomaly_type in ('SCHEMA_ERROR', 'NON_ALIGNED_TIMESTAMP') and row_no is not null")
    out = bad.groupBy("symbol", "archive").agg(F.min_by(F.struct("row_no", "raw_timestamp", "message"), "row_no").alias("f"))
    where = F.format_string("%s row %d: %s", F.col("archive"), F.col("f.row_no"), F.col("f.message"))
    return out.select("symbol", "archive", "f.row_no", "f.raw_timestamp", where.alias("diagnosis"))


def affected_after(events: DataFrame, boundary: str) -> DataFrame:
    """Distinct affected times, and whether any is at or after ``boundary``."""
    late = F.col("parsed_timestamp") >= F.lit(boundary).cast("timestamp_ntz")
    return events.agg(F.count_distinct("symbol", "parsed_timestamp").alias("affected"), F.coalesce(F.max(late), F.lit(False)).alias("any_after"))


def validate_dataset(bars: DataFrame, step: str, symbols: DataFrame) -> DataFrame:
    """Issues of a dataset: (symbol, code, ts) for symbols that aren't among ``symbols``, times that don't increase, missing times."""
    back = F.col("ts") <= F.lag("ts").over(Window.partitionBy("symbol").orderBy("row_no"))
    wrong = bars.join(symbols.select("symbol").distinct(), "symbol", "left_anti").select("symbol", F.lit("symbol").alias("code"), "ts")
    order = bars.withColumn("_b", back).filter("_b").select("symbol", F.lit("ordering").alias("code"), "ts")
    missing = missing_intervals(bars, step).select("symbol", F.lit("missing_interval").alias("code"), "ts")
    return wrong.unionByName(order).unionByName(missing)

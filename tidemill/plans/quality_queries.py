"""Queries over raw rows with anomalies, derived from the hourly event bars: sources, normalising, quality, intervals."""

from __future__ import annotations

import io
from zipfile import ZipFile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import identity, intervals, quality, segments
from ..sources import archives
from ..sources.store import shared_path, written
from . import fixtures as X
from .registering import Registry

Q = Registry()

START, END, MIDDLE = "2024-01-01 00:00:00", "2024-01-31 00:00:00", "2024-01-15 00:00:00"


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows of the event bars by type, see ``as_raw_rows``."""
    return as_raw_rows(X.event_bars(spark, sf_dir, by_type=True))


def as_raw_rows(bars: DataFrame, sparse: int = 1) -> DataFrame:
    """Bars as text rows archived by day, with some off the grid, swapped, doubled, late or cut; fewer of them the larger ``sparse``."""
    df = bars.withColumn("idx", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1)
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint").cast("string")
    t = F.unix_millis(F.to_timestamp("ts")) + F.when(F.col("idx") % (41 * sparse) == 0, 789).otherwise(0)
    text = F.when(F.col("idx") % (71 * sparse) == 5, "bad").when(F.col("idx") % (59 * sparse) == 3, (t * 1000).cast("string")).otherwise(t.cast("string"))
    swap = F.col("idx") % (53 * sparse) == 7
    volume = F.concat(F.when(F.col("idx") % (67 * sparse) == 9, "-").otherwise(""), cents("volume"))
    fields = F.array(text, cents("open"), F.when(swap, cents("low")).otherwise(cents("high")), F.when(swap, cents("high")).otherwise(cents("low")), cents("close"), volume)
    fields = F.when(F.col("idx") % (89 * sparse) == 11, F.slice(fields, 1, 5)).otherwise(fields)
    df = df.withColumns({"fields": fields, "archive": F.concat_ws("", "symbol", F.lit("-1h-"), F.date_format("ts", "yyyy-MM-dd"), F.lit(".zip"))})
    df = df.withColumn("k", F.explode(F.when(F.col("idx") % (83 * sparse) == 13, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    late = F.col("idx") + F.when(F.col("idx") % (97 * sparse) == 17, 3.5).otherwise(0.0)
    order = Window.partitionBy("archive").orderBy(late, "k")
    return df.select("symbol", "archive", F.regexp_replace("archive", "zip$", "csv").alias("member"), F.row_number().over(order).cast("bigint").alias("row_no"), "fields")


def raw_sql(bars: str, end: str, sparse: int = 1) -> str:
    """``as_raw_rows`` of the table ``bars``, its events, regions and certified segments up to ``end``."""
    return f"""with {bars},
  i as (select *, row_number() over (partition by symbol order by ts) - 1 as idx from bars),
  t as (select *, epoch_ms(ts) + case when idx % {41 * sparse} = 0 then 789 else 0 end as t from i),
  f as (select *, case when idx % {71 * sparse} = 5 then 'bad' when idx % {59 * sparse} = 3 then (t * 1000)::varchar else t::varchar end as f0, round(open * 100)::bigint::varchar as f1,
     round((case when idx % {53 * sparse} = 7 then low else high end) * 100)::bigint::varchar as f2, round((case when idx % {53 * sparse} = 7 then high else low end) * 100)::bigint::varchar as f3,
     round(close * 100)::bigint::varchar as f4, (case when idx % {67 * sparse} = 9 then '-' else '' end) || round(volume * 100)::bigint::varchar as f5,
     symbol || '-1h-' || strftime(ts, '%Y-%m-%d') || '.zip' as archive, unnest(case when idx % {83 * sparse} = 13 then [0, 1] else [0] end) as k from t),
  raw as (select symbol, archive, replace(archive, '.zip', '.csv') as member, row_number() over (partition by archive order by idx + case when idx % {97 * sparse} = 17 then 3.5 else 0 end, k) as row_no,
     f0, f1, f2, f3, f4, case when idx % {89 * sparse} = 11 then null else f5 end as f5, case when idx % {89 * sparse} = 11 then 5 else 6 end as n_fields from f),
  u as (select *, try_cast(f0 as bigint) as n, case when try_cast(f0 as bigint) >= 100000000000 and try_cast(f0 as bigint) < 100000000000000 then 'milliseconds' when try_cast(f0 as bigint) >= 100000000000000 and try_cast(f0 as bigint) < 100000000000000000 then 'microseconds' end as unit from raw),
  p as (select *, case unit when 'milliseconds' then make_timestamp(n * 1000) when 'microseconds' then make_timestamp(n) end as ts,
     f1::bigint as o, f2::bigint as h, f3::bigint as l, f4::bigint as c, f5::bigint as v from u),
  q as (select *, coalesce(n_fields >= 6 and ts = date_trunc('hour', ts), false) as aligned from p),
  rows_ as (select *, case when not aligned then null when not (o > 0 and h > 0 and l > 0 and c > 0) then 'price not above zero' when not (l <= o and o <= h) then 'open outside range' when not (l <= c and c <= h) then 'close outside range' when not (v >= 0) then 'volume below zero' end as violation from q),
  flagged as (select *, aligned and row_number() over (partition by symbol, archive, aligned, ts order by row_no) > 1 as duplicate,
     coalesce(aligned and ts < last_value(case when aligned then ts end ignore nulls) over (partition by symbol, archive order by row_no rows between unbounded preceding and 1 preceding), false) as out_of_order from rows_),
  valid as (select symbol, archive, row_no, ts from flagged where aligned and violation is null and not duplicate),
  gaps as (select symbol, archive, unnest(generate_series(ts + interval 1 hour, nxt - interval 1 hour, interval 1 hour)) as ts from (select *, lead(ts) over (partition by symbol, archive order by row_no) as nxt from valid) where nxt > ts + interval 1 hour),
  events_ as (
    select symbol, archive, row_no, f0 as raw_timestamp, ts as parsed_timestamp, 'SCHEMA_ERROR' as anomaly_type from rows_ where n_fields < 6 or ts is null
    union all select symbol, archive, row_no, f0, ts, 'NON_ALIGNED_TIMESTAMP' from rows_ where n_fields >= 6 and ts is not null and not aligned
    union all select symbol, archive, row_no, f0, ts, 'DUPLICATE_TIMESTAMP' from flagged where duplicate
    union all select symbol, archive, row_no, f0, ts, 'OUT_OF_ORDER_TIMESTAMP' from flagged where out_of_order
    union all select symbol, archive, row_no, f0, ts, case when violation like '%volume%' then 'INVALID_VOLUME' else 'INVALID_OHLC' end from rows_ where violation is not null
    union all select symbol, archive, null, null, ts, 'MISSING_INTERVAL' from gaps),
  hours as (select distinct symbol, date_trunc('hour', parsed_timestamp)::timestamp as hour from events_ where parsed_timestamp is not null and parsed_timestamp < timestamp '{end}'),
  hruns as (select *, hour - row_number() over (partition by symbol order by hour) * interval 1 hour as run from hours),
  regions as (select symbol, min(hour) as start, max(hour) + interval 1 hour as "end" from hruns group by symbol, run),
  clean as (select distinct symbol, date_trunc('hour', ts)::timestamp as hour from valid where ts < timestamp '{end}' and (symbol, date_trunc('hour', ts)::timestamp) not in (select (symbol, hour) from hours)),
  pairs as (select a.symbol, a.hour from clean a join clean b on a.symbol = b.symbol and b.hour = a.hour + interval 1 hour),
  restored as (select r.symbol, r.start, coalesce((select min(p.hour) from pairs p where p.symbol = r.symbol and p.hour >= r."end"), r."end") as "end" from regions r),
  inside as (select symbol, greatest(start, timestamp '{START}') as s, least("end", timestamp '{end}') as e from restored where "end" > timestamp '{START}' and start < timestamp '{end}'),
  edges as (select * from inside union all select distinct symbol, timestamp '{end}', timestamp '{end}' from bars),
  cert as (select symbol, cursor as start, s as "end" from (select *, coalesce(max(e) over (partition by symbol order by s, e rows between unbounded preceding and 1 preceding), timestamp '{START}') as cursor from edges) where cursor < s)
"""


RAW_SQL = raw_sql(X.TYPE_SQL, END)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.normalize_klines(raw_rows(spark, sf_dir))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.event_id(quality.scan_quality(rows(spark, sf_dir)))


def _short(df: DataFrame) -> DataFrame:
    return df.select("symbol", "archive", "row_no", "raw_timestamp", "parsed_timestamp", "anomaly_type")


def regions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(affected hours, regions, restored regions)."""
    r = written(rows(spark, sf_dir), "rows")
    hours = written(intervals.affected_hours(intervals.event_id(quality.scan_quality(r)), END), "hours")
    found = intervals.coalesce_regions(hours)
    clean = intervals.clean_hours(quality.valid_timestamps(r), hours, END)
    return hours, found, written(intervals.restore_regions(found, clean), "regions")


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.event_bars(spark, sf_dir, True).select("symbol").distinct()


def zipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw rows as zip archives (path, content, symbol); every 7th has a second member."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        name = key[0].as_py()
        table = table.sort_by("row_no")
        text = "\n".join(",".join(f) for f in table["fields"].to_pylist()) + "\n\n"
        out = io.BytesIO()
        with ZipFile(out, "w") as z:
            z.writestr(name.replace(".zip", ".csv"), text)
            if sum(name.encode()) % 7 == 0:
                z.writestr("extra.csv", "")
        return pa.table({"path": ["x/" + name], "content": [out.getvalue()], "symbol": [table["symbol"][0].as_py()]})

    return raw_rows(spark, sf_dir).groupBy("archive").applyInArrow(pack, "path string, content binary, symbol string")


# Sources and sinks


@Q.add("q_A1", RAW_SQL + "select archive, case when list_sum(list_transform(string_split(archive, ''), lambda x: ascii(x))) % 7 = 0 then 2 else 1 end as members, case when list_sum(list_transform(string_split(archive, ''), lambda x: ascii(x))) % 7 = 0 then 0 else count(*) end as n_rows from raw group by archive")
def q_a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = archives.archive_rows(zipped(spark, sf_dir))
    return got.groupBy("archive", "members").agg(F.count_if(F.size("fields") > 1).alias("n_rows"))


@Q.add("q_A2", RAW_SQL + "select archive, row_no, f0 as raw_timestamp, n_fields from raw")
def q_a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "csv")
    lines = raw_rows(spark, sf_dir).select("archive", "row_no", F.concat_ws(",", "fields").alias("value"))
    lines.repartition("archive").sortWithinPartitions("archive", "row_no").select("archive", "value").write.partitionBy("archive").text(path)
    got = archives.read_kline_csv(spark, path)
    return got.select("archive", "row_no", F.get("fields", F.lit(0)).alias("raw_timestamp"), F.size("fields").alias("n_fields"))


_TEXTS = """with f as (select 'd' || doc_id as archive, text, doc_id from documents where text is not null), c as (select archive, sha256(text) as digest, case when doc_id % 11 = 0 then 'zz' when doc_id % 7 = 0 then repeat('0', 64) else sha256(text) end as expected, doc_id from f)"""


@Q.add("q_A3", _TEXTS + " select archive, digest, expected, case when expected = 'zz' then 'malformed checksum' when expected <> digest then 'checksum mismatch' end as error, expected = digest as verified from c")
def q_a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null")
    files = docs.select(F.concat(F.lit("d"), "doc_id").alias("archive"), F.col("text").cast("binary").alias("content"), "doc_id")
    wrong = F.when(F.col("doc_id") % 11 == 0, "zz").when(F.col("doc_id") % 7 == 0, "0" * 64).otherwise(F.sha2("content", 256))
    return archives.verify_checksums(files, files.select("archive", F.concat_ws("  ", wrong, F.lit("name.zip")).alias("document")))


@Q.add("q_A4", RAW_SQL + "select distinct archive, symbol as archive_symbol, symbol <> 'click' as mismatch from raw")
def q_a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.with_archive_symbol(raw_rows(spark, sf_dir).select("archive").distinct(), F.lit("click"))


@Q.add("q_A5", f"with {X.DAILY_SQL} select symbol, symbol || '-1d-' || strftime(m, '%Y-%m') || '.zip' as archive from (select distinct symbol from bars), (select unnest(generate_series(timestamp '1996-01-01', timestamp '2003-12-01', interval 1 month)) as m) where (symbol, m) not in (select distinct (symbol, date_trunc('month', ts)::timestamp) from bars)")
def q_a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = X.daily_bars(spark, sf_dir)
    have = bars.select(F.format_string("%s-1d-%s.zip", "symbol", F.date_format("ts", "yyyy-MM")).alias("archive")).distinct()
    return archives.missing_archives(archives.expected_archives(spark, bars, "1996-01-01", "2004-01-01", "1d"), have)


@Q.add("q_A6", RAW_SQL + "select symbol, f0 as raw_timestamp, any_value(n_fields) as n_fields from raw group by 1, 2")
def q_a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = raw_rows(spark, sf_dir).groupBy("symbol", "archive").agg(F.to_json(F.collect_list("fields")).alias("page"))
    got = archives.kline_pages(pages.select("symbol", "page"))
    return got.select("symbol", F.get("fields", F.lit(0)).alias("raw_timestamp"), F.size("fields").alias("n_fields"))


@Q.add("q_A7", f"with {X.DAILY_SQL} select symbol, date_trunc('month', ts)::date as date, round(arg_max(close, ts), 6) as close from bars where date_trunc('month', ts) <> date '1998-05-01' group by 1, 2")
def q_a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.allocation import monthly_closes

    closes = monthly_closes(X.daily_bars(spark, sf_dir))
    bars = F.collect_list(F.struct(F.date_format("month", "yyyy-MM-dd'T'00:00:00'Z'").alias("t"), F.col("close").alias("c")))
    payload = closes.groupBy("symbol").agg(bars.alias("b")).select(F.to_json(F.struct(F.create_map("symbol", "b").alias("bars"))).alias("payload"))
    return archives.flatten_bar_payload(payload, "1998-05-20")


@Q.add("q_A8", "select o_orderpriority as symbol, o_orderdate::date as date, round(max(o_totalprice), 6) as value from orders where o_orderstatus <> 'P' group by 1, 2")
def q_a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumns({"t": F.unix_seconds(F.to_timestamp("o_orderdate")), "v": F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))})
    per = df.groupBy(F.col("o_orderpriority").alias("symbol"), "t").agg(F.max("v").alias("v"))
    parallel = per.groupBy("symbol", F.floor(F.col("t") / 2_592_000).alias("m")).agg(F.collect_list(F.struct("t", "v")).alias("z"))
    return archives.flatten_history(parallel.select("symbol", F.col("z.t").alias("timestamp"), F.col("z.v").alias("equity")))


@Q.add("q_A9", RAW_SQL + "select symbol, anomaly_type, count(*) as n from events_ group by 1, 2")
def q_a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "evidence")
    archives.write_evidence(events(spark, sf_dir), path, ("symbol", "anomaly_type"), "json")
    return spark.read.schema("archive string, symbol string, anomaly_type string").json(path).groupBy("symbol", "anomaly_type").agg(F.count("*").alias("n"))


@Q.add("q_A10", "select o_orderpriority as hypothesis, 2 * count(*) as n from orders group by 1")
def q_a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "records")
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("experiment_id"), F.col("o_orderpriority").alias("hypothesis"), F.lit(0.001).alias("fee"), F.lit(0.0).alias("slip"), F.create_map(F.lit("status"), "o_orderstatus").alias("parameters"))
    for _ in range(2):
        archives.append_experiment(df, path)
    return spark.read.schema(df.schema).parquet(path).groupBy("hypothesis").agg(F.count("*").alias("n"))


@Q.add("q_A11", "select 'd' || doc_id as file, sha256(text) as sha256 from documents where text is not null")
def q_a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null")
    return archives.file_hashes(docs.select(F.concat(F.lit("a/b/d"), "doc_id").alias("path"), F.col("text").cast("binary").alias("content")))


# Normalising


@Q.add("q_B1_B2_B3", RAW_SQL + "select archive, row_no, unit, ts, coalesce(ts = date_trunc('hour', ts), false) as aligned from rows_")
def q_b1(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = raw_rows(spark, sf_dir).withColumn("t", F.get("fields", F.lit(0)))
    ts = C.epoch_to_ts(F.col("t"))
    return r.select("archive", "row_no", C.epoch_unit(F.col("t")).alias("unit"), ts.alias("ts"), F.coalesce(C.is_aligned(ts), F.lit(False)).alias("aligned"))


@Q.add("q_B4_B5", RAW_SQL + "select archive, row_no, upper(symbol) as canonical, o::double as open, v::double as volume from rows_")
def q_b4(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _symbols(spark, sf_dir).select("symbol", F.upper("symbol").alias("canonical"))
    got = quality.normalize_klines(raw_rows(spark, sf_dir), names)
    return got.select("archive", "row_no", "canonical", F.col("open").cast("double").alias("open"), F.col("volume").cast("double").alias("volume"))


@Q.add("q_B6", RAW_SQL + "select symbol, archive, count(distinct unit) as units, count(distinct unit) > 1 as mixed from rows_ group by 1, 2")
def q_b6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.mixed_units(rows(spark, sf_dir))


@Q.add("q_B7", RAW_SQL + "select violation, count(*) as n from rows_ where aligned group by 1")
def q_b7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).filter("aligned").groupBy("violation").agg(F.count("*").alias("n"))


@Q.add("q_B8", RAW_SQL + f"select symbol, count(*) as n from bars where ts >= timestamp '{MIDDLE}' and ts < timestamp '{END}' group by 1")
def q_b8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.in_window(X.event_bars(spark, sf_dir, True), MIDDLE, END).groupBy("symbol").agg(F.count("*").alias("n"))


@Q.add("q_B9", RAW_SQL + "select symbol, ts, c::double as close from rows_ where (symbol, archive, ts) in (select (symbol, archive, ts) from valid)")
def q_b9(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir)
    return quality.keep_valid(r, quality.valid_timestamps(r)).select("symbol", "ts", F.col("close").cast("double").alias("close"))


def _partitions(spark: SparkSession) -> DataFrame:
    table = [("development", START, "2024-01-10 00:00:00"), ("validation", "2024-01-10 00:00:00", "2024-01-20 00:00:00"), ("oos", "2024-01-21 00:00:00", END)]
    return spark.createDataFrame(table, "name string, start string, end string").select("name", F.col("start").cast("timestamp_ntz"), F.col("end").cast("timestamp_ntz"))


_PARTS = f"parts(name, start, \"end\") as (values ('development', timestamp '{START}', timestamp '2024-01-10'), ('validation', timestamp '2024-01-10', timestamp '2024-01-20'), ('oos', timestamp '2024-01-21', timestamp '{END}'))"


@Q.add("q_B10", f"with {X.TYPE_SQL}, {_PARTS} select symbol, name as partition, count(*) as n from bars left join parts on ts >= start and ts < \"end\" group by 1, 2")
def q_b10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.with_partition(X.event_bars(spark, sf_dir, True), _partitions(spark)).groupBy("symbol", "partition").agg(F.count("*").alias("n"))


@Q.add("q_B11", f"with {X.TYPE_SQL}, w as (select symbol as name, min(ts) as start, max(ts) as \"end\" from bars group by 1), b as (select *, lag(\"end\") over o as before, lead(start) over o as after from w window o as (order by start, \"end\", name)), e as (select name, case when start >= \"end\" then 'start must be before end' when before <> start then 'partitions must be contiguous' when before is null and start <> timestamp '{START}' then 'window start not covered' when after is null and \"end\" <> timestamp '{END}' then 'window end not covered' end as error from b) select * from e where error is not null")
def q_b11(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = X.event_bars(spark, sf_dir, True).groupBy(F.col("symbol").alias("name")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    return quality.validate_partitions(span, START, END)


@Q.add("q_B12", "select date_trunc('hour', ts)::timestamp as hour, count(*) as n from events group by 1")
def q_b12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(C.floor_interval(F.col("ts")).alias("hour")).agg(F.count("*").alias("n"))


# Quality scan


@Q.add("q_C1", "select c_mktsegment as symbol, 'A-1h-' || c_custkey as archive, case when c_custkey % 3 = 0 then 'archive does not hold exactly one file' when c_custkey % 3 = 1 then 'file in the archive is of another symbol' else 'file in the archive has another kind of name' end as message from customer where c_custkey % 4 <> 0 or c_custkey % 3 = 0")
def q_c1(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.col("c_custkey")
    right, other = F.concat("c_mktsegment", F.lit("-1h-2024-01.csv")), F.when(key % 3 == 1, "OTHER-1h-2024-01.csv").otherwise("data.txt")
    df = c.select(F.col("c_mktsegment").alias("symbol"), F.concat(F.lit("A-1h-"), key).alias("archive"), F.when(key % 4 == 0, right).otherwise(other).alias("member"), F.when(key % 3 == 0, 2).otherwise(1).alias("members"))
    return quality.scan_structure(df).select("symbol", "archive", "message")


def _scan(name: str, kind: str, scan) -> None:  # noqa: ANN001
    @Q.add(name, RAW_SQL + f"select * from events_ where anomaly_type in ({kind})")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _short(scan(rows(spark, sf_dir)))


_scan("q_C2", "'SCHEMA_ERROR'", quality.scan_schema)
_scan("q_C3", "'NON_ALIGNED_TIMESTAMP'", quality.scan_alignment)
_scan("q_C4", "'DUPLICATE_TIMESTAMP'", quality.scan_duplicates)
_scan("q_C5", "'OUT_OF_ORDER_TIMESTAMP'", quality.scan_order)
_scan("q_C6", "'INVALID_OHLC', 'INVALID_VOLUME'", quality.scan_values)
_scan("q_C7", "'MISSING_INTERVAL'", quality.scan_gaps)


@Q.add("q_C8", _TEXTS + " select archive, 'digest differs from the published one' as message from c where expected <> digest")
def q_c8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scan_checksums(q_a3(spark, sf_dir).withColumn("symbol", F.lit("d"))).select("archive", "message")


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, with unreadable times and the gaps of the first days as known issues."""
    e = quality.scan_quality(rows(spark, sf_dir))
    files = e.filter("archive like '%01-0%'").select("archive").distinct().select(F.lit(None).cast("string").alias("raw_timestamp"), "archive", F.lit("issue #1").alias("issue"))
    known = files.unionByName(spark.range(1).select(F.lit("bad").alias("raw_timestamp"), F.lit(None).cast("string").alias("archive"), F.lit("issue #2").alias("issue")))
    return quality.tag_provenance(e, known)


@Q.add("q_C9", RAW_SQL + "select anomaly_type, case when anomaly_type = 'MISSING_INTERVAL' and archive like '%01-0%' then 'issue #1' when anomaly_type <> 'MISSING_INTERVAL' and raw_timestamp = 'bad' then 'issue #2' else 'archive' end as source_provenance, count(*) as n from events_ group by 1, 2")
def q_c9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged(spark, sf_dir).groupBy("anomaly_type", "source_provenance").agg(F.count("*").alias("n"))


@Q.add("q_C10", RAW_SQL + "select * from valid")
def q_c10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.valid_timestamps(rows(spark, sf_dir))


@Q.add("q_C11", RAW_SQL + "select case when count(*) = 0 then 'VALID' else 'UNUSABLE' end as certification from events_")
def q_c11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.certify(quality.scan_quality(rows(spark, sf_dir)), "issue #")


@Q.add("q_C11_archives", RAW_SQL + """select archive, case when count(e.anomaly_type) = 0 then 'VALID' when bool_and((anomaly_type = 'MISSING_INTERVAL' and archive like '%01-0%') or (anomaly_type <> 'MISSING_INTERVAL' and coalesce(raw_timestamp = 'bad', false))) then 'VALID WITH DOCUMENTED SOURCE ANOMALIES' else 'UNUSABLE' end as certification
  from (select distinct archive from raw) left join events_ e using (archive) group by archive""")
def q_c11_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every archive on its own, clean ones included."""
    return quality.certify(tagged(spark, sf_dir), "issue #", rows(spark, sf_dir).select("archive").distinct())


@Q.add("q_C12", RAW_SQL + """select symbol, (select count(*) from raw r where r.symbol = e.symbol) as rows_processed, count(*) filter (anomaly_type = 'SCHEMA_ERROR') as schema_error, count(*) filter (anomaly_type = 'NON_ALIGNED_TIMESTAMP') as non_aligned_timestamp,
  count(*) filter (anomaly_type = 'DUPLICATE_TIMESTAMP') as duplicate_timestamp, count(*) filter (anomaly_type = 'OUT_OF_ORDER_TIMESTAMP') as out_of_order_timestamp, count(*) filter (anomaly_type = 'INVALID_OHLC') as invalid_ohlc, count(*) filter (anomaly_type = 'INVALID_VOLUME') as invalid_volume,
  count(*) filter (anomaly_type = 'MISSING_INTERVAL') as missing_interval, 0 as checksum_failure, count(distinct case when row_no is not null then (archive, row_no) end) as invalid_rows from events_ e group by symbol""")
def q_c12(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir)
    return quality.summarize_quality(r, quality.scan_quality(r))


@Q.add("q_C13", RAW_SQL + """, o as (select symbol, ts, row_number() over (partition by symbol order by archive, row_no) as k from rows_ where aligned), m as (select distinct symbol, ts from o)
  select symbol, 'symbol' as code, ts from o where symbol = 'error' union all select symbol, 'ordering', ts from (select *, lag(ts) over (partition by symbol order by k) as b from o) where ts <= b
  union all select symbol, 'missing_interval', unnest(generate_series(ts + interval 1 hour, nxt - interval 1 hour, interval 1 hour)) from (select *, lead(ts) over (partition by symbol order by ts) as nxt from m) where nxt > ts + interval 1 hour""")
def q_c13(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir).filter("aligned")
    r = r.withColumn("row_no", F.row_number().over(Window.partitionBy("symbol").orderBy("archive", "row_no")))
    names = _symbols(spark, sf_dir).filter("symbol <> 'error'")
    return quality.validate_dataset(r.select("symbol", "ts", "row_no"), "1 hour", names)


@Q.add("q_C14", RAW_SQL + "select symbol, count(*) filter (ts <= b) = 0 as increasing from (select symbol, ts, lag(ts) over (partition by symbol order by archive, row_no) as b from rows_ where aligned) group by 1")
def q_c14(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rows(spark, sf_dir).filter("aligned").withColumn("_o", F.struct("archive", "row_no"))
    return quality.check_monotonic(r, "_o")


@Q.add("q_C15", f"with {X.GAP_SQL} select symbol, unnest(generate_series(ts + interval 1 day, nxt - interval 1 day, interval 1 day)) as ts from (select *, lead(ts) over (partition by symbol order by ts) as nxt from bars) where nxt > ts + interval 1 day")
def q_c15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.missing_intervals(X.gap_bars(spark, sf_dir), "1 day")


@Q.add("q_C16", f"with {X.TYPE_SQL} select symbol, min(ts) as first, max(ts) as last, count(distinct ts) as rows, 720 as expected, min(ts) = timestamp '{START}' and max(ts) = timestamp '{END}' - interval 1 hour and count(distinct ts) = 720 as complete from bars group by 1")
def q_c16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.require_complete(X.event_bars(spark, sf_dir, True), START, END, "1 hour")


@Q.add("q_C17", f"with {X.TYPE_SQL} select greatest(max(f), timestamp '{START}') as common_start, case when greatest(max(f), timestamp '{START}') >= timestamp '{END}' then 'no common window' end as error from (select min(ts) as f from bars group by symbol)")
def q_c17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.common_start(X.event_bars(spark, sf_dir, True), START, END)


@Q.add("q_C18", RAW_SQL + "select symbol, archive, min(row_no) as row_no, arg_min(raw_timestamp, row_no) as raw_timestamp from events_ where anomaly_type in ('SCHEMA_ERROR', 'NON_ALIGNED_TIMESTAMP') group by 1, 2")
def q_c18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.first_bad_row(quality.scan_quality(rows(spark, sf_dir))).select("symbol", "archive", "row_no", "raw_timestamp")


@Q.add("q_C19", RAW_SQL + f"select count(distinct case when parsed_timestamp is not null then (symbol, parsed_timestamp) end) as affected, coalesce(bool_or(parsed_timestamp >= timestamp '{MIDDLE}'), false) as any_after from events_")
def q_c19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.affected_after(quality.scan_quality(rows(spark, sf_dir)), MIDDLE)


# Intervals


@Q.add("q_D1", RAW_SQL + "select symbol, date_trunc('hour', parsed_timestamp)::timestamp as hour, count(*) as ids from (select distinct * from events_) where parsed_timestamp is not null group by 1, 2")
def q_d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir)[0].select("symbol", "hour", F.size("anomaly_ids").alias("ids"))


@Q.add("q_D2", RAW_SQL + "select * from regions")
def q_d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir)[1].drop("anomaly_ids")


@Q.add("q_D3", RAW_SQL + "select * from restored")
def q_d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions(spark, sf_dir)[2].drop("anomaly_ids")


@Q.add("q_D4", RAW_SQL + "select * from cert")
def q_d4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.certified_segments(regions(spark, sf_dir)[2], _symbols(spark, sf_dir), START, END)


@Q.add("q_D5", RAW_SQL + f"select symbol, greatest(start, timestamp '{MIDDLE}') as start, least(\"end\", timestamp '{END}') as \"end\" from restored where greatest(start, timestamp '{MIDDLE}') < least(\"end\", timestamp '{END}')")
def q_d5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.clip_regions(regions(spark, sf_dir)[2], MIDDLE, END).drop("anomaly_ids")


@Q.add("q_D6", RAW_SQL + f", {_PARTS}" + """, bad as (select symbol, bool_or(parsed_timestamp is null) as lost from events_ group by 1)
  select symbol, name, case when lost then 'UNUSABLE' when exists (select 1 from restored r where r.symbol = s.symbol and r.start < parts."end" and parts.start < r."end") then 'VALID WITH DOCUMENTED EXCLUSIONS' else 'VALID' end as certification
  from (select distinct symbol from bars) s cross join parts left join bad using (symbol)""")
def q_d6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.certification(events(spark, sf_dir), regions(spark, sf_dir)[2], _symbols(spark, sf_dir), _partitions(spark))


@Q.add("q_D7", RAW_SQL + "select symbol, start, \"end\", 'bars on both sides of an affected region belong to different segments' as reason from restored")
def q_d7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.continuity_breaks(regions(spark, sf_dir)[2]).drop("anomaly_ids")


@Q.add("q_D8", RAW_SQL + "select symbol, ts, close from bars b where not exists (select 1 from restored r where r.symbol = b.symbol and b.ts >= r.start and b.ts < r.\"end\")")
def q_d8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.outside_intervals(X.event_bars(spark, sf_dir, True), regions(spark, sf_dir)[2]).select("symbol", "ts", "close")


@Q.add("q_D8_certified", RAW_SQL + "select symbol, ts from bars b where exists (select 1 from cert c where c.symbol = b.symbol and b.ts >= c.start and b.ts < c.\"end\")")
def q_d8_certified(spark: SparkSession, sf_dir: str) -> DataFrame:
    cert = intervals.certified_segments(regions(spark, sf_dir)[2], _symbols(spark, sf_dir), START, END)
    return segments.inside_intervals(X.event_bars(spark, sf_dir, True), cert).select("symbol", "ts")


@Q.add("q_D8_boundary", RAW_SQL + "select symbol, ts, case when exists (select 1 from restored r where r.symbol = b.symbol and b.ts >= r.start and b.ts < r.\"end\") then 'DATA_BOUNDARY_TERMINATION' end as termination from bars b")
def q_d8_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.boundary_termination(X.event_bars(spark, sf_dir, True), regions(spark, sf_dir)[2]).select("symbol", "ts", "termination")


@Q.add("q_D9", RAW_SQL.replace("with bars as", "with allbars as", 1).replace("from bars", "from allbars") + f", bars as (select * from allbars b where not exists (select 1 from restored r where r.symbol = b.symbol and b.ts >= r.start and b.ts < r.\"end\")), {X.segments_sql('1 hour')} select symbol, ts, segment_id, bar_idx from seg")
def q_d9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.continuous_segments(X.event_bars(spark, sf_dir, True), "1 hour", regions(spark, sf_dir)[2]).select("symbol", "ts", "segment_id", "bar_idx")


@Q.add("q_D10", RAW_SQL + """, m as (select symbol, ts, exists (select 1 from restored r where r.symbol = b.symbol and b.ts >= r.start and b.ts < r."end") as blocked from bars b), s as (select *, sum(blocked::int) over (partition by symbol order by ts) as g from m)
  select symbol, ts, dense_rank() over (partition by symbol order by g) - 1 as series_id from s where not blocked""")
def q_d10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.split_series(X.event_bars(spark, sf_dir, True), regions(spark, sf_dir)[2]).select("symbol", "ts", "series_id")


@Q.add("q_D13", RAW_SQL + """, x as (select greatest(a.start, b.start) as start, least(a."end", b."end") as "end" from cert a join cert b on a.start < b."end" and b.start < a."end" where a.symbol = 'click' and b.symbol = 'purchase'),
  x1 as (select *, case when start = lag("end") over (order by start) then 0 else 1 end as fresh from x), x2 as (select *, sum(fresh) over (order by start) as run from x1) select min(start) as start, max("end") as "end" from x2 group by run""")
def q_d13(spark: SparkSession, sf_dir: str) -> DataFrame:
    cert = intervals.certified_segments(regions(spark, sf_dir)[2], _symbols(spark, sf_dir), START, END)
    return intervals.common_intervals(cert.filter("symbol = 'click'"), cert.filter("symbol = 'purchase'"))


@Q.add("q_D14", RAW_SQL + "select greatest(a.start, b.start) as start, least(a.\"end\", b.\"end\") as \"end\" from restored a join restored b on a.start < b.\"end\" and b.start < a.\"end\" where a.symbol = 'click' and b.symbol = 'purchase'")
def q_d14(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = regions(spark, sf_dir)[2]
    return intervals.common_breaks(r.filter("symbol = 'click'"), r.filter("symbol = 'purchase'"))


@Q.add("q_D15", RAW_SQL + "select case when count(*) = 0 then 'UNUSABLE' else 'VALID WITH DOCUMENTED EXCLUSIONS' end as certification from cert a join cert b on a.start < b.\"end\" and b.start < a.\"end\" where a.symbol = 'click' and b.symbol = 'purchase'")
def q_d15(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = q_d6(spark, sf_dir).filter("symbol in ('click', 'purchase')")
    return intervals.common_certification(labels, q_d13(spark, sf_dir))


@Q.add("q_D16", RAW_SQL.split(",\n  i as")[0] + f", allbars as (select * from bars), pair as (select p.*, c.close as lead_close from allbars p join allbars c on c.symbol = 'click' and p.symbol = 'purchase' and c.ts = p.ts), {X.segments_sql('1 hour').replace('from bars', 'from pair').replace('select symbol, ts, open', 'select symbol, lead_close, ts, open')} select ts, lead_close, close, segment_id, bar_idx from seg")
def q_d16(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = X.event_bars(spark, sf_dir, True)
    got = segments.synchronized_segments(bars.filter("symbol = 'click'"), bars.filter("symbol = 'purchase'"), "1 hour")
    return got.select("ts", "lead_close", "close", "segment_id", "bar_idx")


@Q.add("q_D17")
def q_d17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", "symbol", "anomaly_type")


_LINES = f"""with {X.DAILY_SQL}, d as (select symbol, date_trunc('month', ts) as month, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '|' || symbol || '|' || open::decimal(20,8)::varchar || '|' || high::decimal(20,8)::varchar || '|' || low::decimal(20,8)::varchar || '|' || close::decimal(20,8)::varchar || '|' || volume::decimal(20,8)::varchar as line, ts from bars),
  m as (select symbol, month, count(*) as n, sha256(string_agg(line, chr(10) order by line)) as h from d group by 1, 2), r as (select symbol, sum(n)::bigint as rows, sha256('version=v1' || chr(10) || string_agg(h, chr(10) order by month)) as dataset_id from m group by 1)"""


@Q.add("q_D18", _LINES + " select symbol, rows, dataset_id from r")
def q_d18(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.dataset_identity(X.daily_bars(spark, sf_dir), "v1")


@Q.add("q_D19", "with h as (select substr(sha256('d' || doc_id), 1, 4) as deal, sha256(string_agg('d' || doc_id || ':' || sha256(text), chr(10) order by 'd' || doc_id || ':' || sha256(text))) as t, count(*) as n from documents where text is not null group by 1) select coalesce(sum(n), 0)::bigint as files, sha256(string_agg(t, chr(10) order by deal)) as identity from h")
def q_d19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.archive_set_identity(q_a11(spark, sf_dir))


@Q.add("q_D20", _LINES + " select symbol, min(ts) as start_ts, max(ts) as end_ts, any_value(rows) as rows, any_value(dataset_id) as dataset_id, '1d' as timeframe, 'v1' as normalization_version from d join r using (symbol) group by symbol")
def q_d20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.dataset_metadata(X.daily_bars(spark, sf_dir), "v1", "1d")


_TREE = _LINES.split(", m as (")[0] + """, l0 as (select symbol, row_number() over (partition by symbol order by line) - 1 as place, sha256(line) as h from d), n as (select symbol, count(*) as rows from l0 group by 1),
  l1 as (select symbol, place // 64 as place, case when any_value(rows) > 1 then sha256(string_agg(h, chr(10) order by place)) else any_value(h) end as h from l0 join n using (symbol) group by 1, 2),
  l2 as (select symbol, place // 64 as place, case when any_value(rows) > 64 then sha256(string_agg(h, chr(10) order by place)) else any_value(h) end as h from l1 join n using (symbol) group by 1, 2),
  l3 as (select symbol, case when any_value(rows) > 64 * 64 then sha256(string_agg(h, chr(10) order by place)) else any_value(h) end as h from l2 join n using (symbol) group by 1)
  select symbol, rows, sha256('version=v1' || chr(10) || rows || chr(10) || h) as dataset_id from l3 join n using (symbol)"""


@Q.add("q_D18_tree", _TREE)
def q_d18_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The identity of daily bars by a tree of hashes, built from those before 1996 and extended by the others."""
    bars = X.daily_bars(spark, sf_dir)
    early = F.col("ts") < F.lit("1996-01-01").cast("timestamp_ntz")
    first = written(identity.tree_frontier(bars.filter(early), run=64), "frontier")
    return identity.tree_identity(identity.tree_frontier(bars.filter(~early), first, 64), "v1", 64)


@Q.add("q_A10_once", "select o_orderpriority as hypothesis, count(*) as n from orders group by 1")
def q_a10_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records committed twice, the second time with all others: one copy of each."""
    path = shared_path(spark, "commits")
    df = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("experiment_id"), F.col("o_orderpriority").alias("hypothesis"), F.lit(0.001).alias("fee"), F.lit(0.0).alias("slip"), F.create_map(F.lit("status"), "o_orderstatus").alias("parameters"))
    archives.commit_experiments(df.filter("crc32(experiment_id) % 2 = 0"), path)
    archives.commit_experiments(df, path)
    return archives.committed(spark, path).groupBy("hypothesis").agg(F.count("*").alias("n"))

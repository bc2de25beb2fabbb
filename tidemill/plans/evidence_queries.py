"""All cycles from raw rows to committed decisions, and inputs that bring out every label and error, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import allocation, classifier, event_study, indicators, intervals, metrics, quality, research, robustness, signals
from ..sources import archives
from ..sources.store import shared_path, written
from . import fixtures as X
from . import quality_queries as raw
from . import study_queries as S
from .registering import Registry

Q = Registry()

#: Day k of the daily bars is hour k from here, so that hourly archives have as many bars.
FIRST, LAST, SPARSE = "2024-01-01", "2025-01-01 00:00:00", 10
_CYCLES = {cycle: names for cycle, names, _ in S.CYCLES}
_HELD = tuple(n for n in signals.BASES if signals.SIGNALS[n].hold)
_HOURS_SQL = X.DAILY_SQL.replace("bars as (", "days as (", 1) + f", bars as (select symbol, timestamp '{FIRST}' + datediff('day', date '1992-01-01', ts::date) * interval 1 hour as ts, open, high, low, close, volume from days)"


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily bars of ``lineitem`` as text rows of hourly archives, some of them faulty."""
    hours = F.make_dt_interval(hours=F.datediff("ts", F.lit("1992-01-01").cast("date")))
    bars = X.daily_bars(spark, sf_dir).withColumn("ts", F.lit(FIRST).cast("timestamp_ntz") + hours)
    return raw.as_raw_rows(bars, SPARSE)


_OUT = "not exists (select 1 from restored x where x.symbol = r.symbol and r.ts >= x.start and r.ts < x.\"end\")"
_TREATED = raw.raw_sql(_HOURS_SQL, LAST, SPARSE) + f", treated as materialized (select symbol, ts, o::double as open, h::double as high, l::double as low, c::double as close, v::double as volume from rows_ r where (symbol, archive, ts) in (select (symbol, archive, ts) from valid) and {_OUT})"
_SEG = _TREATED + ", " + X.segments_sql("1 hour").replace("from bars", "from treated").replace("seg as (", "seg as materialized (")
_PAIRED = S._pair_of(_TREATED, "treated", "A", "N")


def _named(battery: str, cells: dict[str, int]) -> str:
    return "select case cell " + " ".join(f"when {c} then '{n}'" for n, c in cells.items()) + f" end as hypothesis, failed, required, passed, decision from ({battery})"


_NINE = {n: research.SPAN * k + signals.base_cell(n) for k, n in enumerate(_HELD)}
_HITS_OF = {n: f"f2 join g_{n} as cells on bar_idx >= 1 and {S._RULES[n]}" for n in _HELD if n in S._RULES} | {"hyp0024": "ranked join g_hyp0024 as cells on rank <= quantile and close >= xh * (1 + buffer)"}
_HELD_HITS = f"{_SEG}{S._FEAT}{S._RANK}{S._GRIDS}, cells(cell) as (values {', '.join(f'({c})' for c in _NINE.values())}), hits as (" + " union all ".join(f"select {research.SPAN * k} + cell as cell, symbol, segment_id, bar_idx, hold_bars::int as hold from {_HITS_OF[n]}" for k, n in enumerate(_HELD)) + ")"
_PAIR_BASE = {"hyp0006": signals.base_cell("hyp0006")}
_LEAD = _PAIRED + S._cells_sql("hyp0006").replace("cells(", "g_hyp0006(", 1) + f", cells(cell) as (values ({_PAIR_BASE['hyp0006']})), hits as (select cell, symbol, segment_id, bar_idx from pr join g_hyp0006 on bar_idx >= 1 and lr >= lead_threshold and lr - r1 >= gap)"
_EACH = " union all ".join(
    f"select * from ({q})"
    for q in (
        _named(S._battery_sql(False, S._all_hits(_SEG), "cell // 1000"), S._BASES_OF),
        _named(S._battery_sql(True, _HELD_HITS, "cell // 1000", held=True), _NINE),
        _named(S._battery_sql(False, _LEAD, control=True), _PAIR_BASE),
    )
)
_OF = ", ".join(f"('{c}', '{n}', {str(c == '7').lower()})" for c, names in _CYCLES.items() for n in names)


@Q.add(
    "q_J15_evidence",
    f"""with each_ as materialized ({_EACH}), of_(cycle, hypothesis, one) as (values {_OF}), every_ as (select * from of_ left join each_ using (hypothesis))
  select cycle, hypothesis, failed, required, passed, decision from every_
  union all select cycle, 'overall', coalesce(string_agg(hypothesis, ',' order by hypothesis) filter (decision <> 'PASS'), ''), case when one then 1 else count(*) end, count(*) filter (decision = 'PASS'), case when count(*) filter (decision = 'PASS') >= case when one then 1 else count(*) end then 'PASS' else 'FAIL' end from every_ group by cycle, one""",
)
def q_j15_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 21 hypotheses and seven cycles from raw text rows to records that were committed and read again."""
    found = written(research.run_cycles(quality.normalize_klines(raw_rows(spark, sf_dir)), LAST, "A", "N", _CYCLES), "decisions")
    path = shared_path(spark, "decisions")
    research.commit_decisions(found, path, "v1")
    return archives.committed(spark, path).select("cycle", "hypothesis", F.array_join("failed", ",").alias("failed"), "required", "passed", "decision")


# Labels of every two symbols by partitions of two hours, one symbol with a checksum that failed

_PIECES = 120
_PARTS = f"parts as (select 'p' || lpad(k::varchar, 3, '0') as name, timestamp '{FIRST}' + (datediff('day', date '1992-01-01', date '1995-01-02') + 2 * k) * interval 1 hour as start from range({_PIECES}) r(k))"


@Q.add(
    "q_D15_pairs",
    raw.raw_sql(_HOURS_SQL, LAST, SPARSE)
    + f""", {_PARTS}, windows as (select name, start, start + interval 2 hour as "end" from parts),
  labels as (select symbol, name, case when symbol = 'R' then 'UNVERIFIED' when exists (select 1 from restored x where x.symbol = y.symbol and x.start < w."end" and w.start < x."end") then 'VALID WITH DOCUMENTED EXCLUSIONS' else 'VALID' end as label from (select distinct symbol from bars) y cross join windows w),
  duo as (select a.symbol as symbol_a, b.symbol as symbol_b, a.name, a.label as la, b.label as lb from labels a join labels b on a.name = b.name and a.symbol < b.symbol),
  common as (select distinct a.symbol as symbol_a, b.symbol as symbol_b, w.name from cert a join cert b on a.symbol < b.symbol join windows w on greatest(a.start, b.start, w.start) < least(a."end", b."end", w."end"))
  select symbol_a, symbol_b, name, case when 'UNVERIFIED' in (la, lb) then 'UNVERIFIED' when c.name is null then 'UNUSABLE' when la = 'VALID' and lb = 'VALID' then 'VALID' else 'VALID WITH DOCUMENTED EXCLUSIONS' end as certification from duo left join common c using (symbol_a, symbol_b, name)""",
)
def q_d15_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(quality.normalize_klines(raw_rows(spark, sf_dir)), "rows")
    events = written(intervals.event_id(quality.scan_quality(rows)), "events")
    _, breaks = research.treated_bars(rows, LAST)
    symbols = rows.select("symbol").distinct()
    certified = written(intervals.certified_segments(breaks, symbols, raw.START, LAST), "certified")
    first = F.lit(FIRST).cast("timestamp_ntz") + F.expr("make_dt_interval(0, datediff(date '1995-01-02', date '1992-01-01') + 2 * int(id))")
    parts = spark.range(_PIECES).select(F.concat(F.lit("p"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("name"), first.alias("start")).withColumn("end", F.col("start") + F.expr("interval 2 hours"))
    failed = events.filter("symbol = 'R'").dropDuplicates(["symbol"]).withColumn("anomaly_type", F.lit("CHECKSUM_FAILURE"))
    known = events.filter("parsed_timestamp is not null").unionByName(failed)
    return intervals.common_certifications(written(intervals.certification(known, breaks, symbols, parts), "labels"), certified, parts)


# Inputs that bring out every error

_ACCOUNTS = "a as (select c_custkey as account, o_orderkey, o_totalprice::double - 50000 as equity, case when c_custkey % 10 = 0 or o_orderkey % 89 = 0 then null when o_orderkey % 97 = 0 then 2.0 else 0.5 end as position from customer left join orders on o_custkey = c_custkey and o_orderstatus = 'F')"


@Q.add("q_I15_faults", f"with {_ACCOUNTS} select account, case when count(o_orderkey) = 0 then 'no equity' when count(position) filter (o_orderkey is not null) between 1 and count(*) - 1 then 'positions are incomplete' when bool_or(position > 1) filter (o_orderkey is not null) then 'a position is outside 0 to 1' when arg_min(equity, o_orderkey) <= 0 then 'equity starts at zero or less' end as error from a group by 1")
def q_i15_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curve per customer: their finished orders in order, some with bad positions; some customers have none."""
    account = F.col("o_custkey").alias("account")
    position = F.when((F.col("o_custkey") % 10 == 0) | (F.col("o_orderkey") % 89 == 0), None).when(F.col("o_orderkey") % 97 == 0, 2.0).otherwise(0.5)
    curves = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderstatus = 'F'").select(account, "o_orderkey", (F.col("o_totalprice").cast("double") - 50_000).alias("equity"), position.alias("position"))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("account"))
    return metrics.validate_metrics_input(curves, ["account"], "o_orderkey", customers)


_SALES = "closes as (select o_custkey as symbol, date_trunc('month', o_orderdate)::date as month, sum(o_totalprice)::double - 60000 as close from orders where o_orderstatus = 'F' group by 1, 2), r as (select *, row_number() over (partition by symbol order by month desc) as k from closes), tr as (select symbol, count(*) as months, arg_max(close, month) > avg(close) as up, case when count(*) < 3 then 'too few monthly closes' when min(close) <= 0 then 'closes must be positive' end as error from r where k <= 3 group by 1)"


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly finished orders by customer less a fixed amount: many have few months, some fall below zero."""
    month = F.date_trunc("month", "o_orderdate").cast("date").alias("month")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("symbol"), month).agg((F.sum("o_totalprice").cast("double") - 60_000).alias("close"))


@Q.add("q_E23_errors", f"with {_SALES} select symbol, months, case when error is null then up end as up, error from tr")
def q_e23_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.trend_up(_sales(spark, sf_dir), 3).select("symbol", "months", "up", "error")


@Q.add("q_K1_errors", f"with {_SALES} select c_custkey as symbol, case when tr.symbol is not null and error is null then case when up then round(1e6 / (select count(*) from customer), 6)::double else 0.0 end end as weight_ppm, case when tr.symbol is null then 'missing price history' else error end as error from customer left join tr on tr.symbol = c_custkey")
def q_k1_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of all customers in parts per million, and why some have none."""
    universe = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("symbol"))
    return allocation.target_weights(_sales(spark, sf_dir), universe, 3).select("symbol", (F.col("weight") * 1e6).alias("weight_ppm"), "error")


@Q.add("q_J16_stress", S._SEGS + ", sz as (select symbol, segment_id, count(*) as bars from seg group by 1, 2) select c.cell, z.symbol, x.cost, x.delay, z.segment_id, z.bars, coalesce(r.events, 0) as events, round(asinh(r.sret), 6) as segment_return, case when z.bars < 100 then 'segment of ' || z.bars || ' bars, 100 needed' when r.sret <= -1 then 'segment lost everything' when r.events is null then 'no events' end as error from sz z cross join cells c cross join (select distinct cost, delay from stress) x left join sr r on r.cell = c.cell and r.symbol = z.symbol and r.segment_id = z.segment_id and r.cost = x.cost and r.delay = x.delay")
def q_j16_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell under every cost case and delay on every segment."""
    seg, ev = S.study(spark, sf_dir)
    cases = signals.param_grid(spark, S.SHOCK).select("cell").crossJoin(event_study.stress_grid(spark).select("cost", "delay"))
    return robustness.segment_rows(seg, ev, cases, S.KEYS, 100).withColumn("segment_return", F.asinh("segment_return"))


@Q.add("q_L3_sides", S._ML + ", test as (select * from trades where n >= 10 and k > floor(n * 0.7)) select 'before' as stage, count(*) as trades, round(coalesce(100.0 * count(*) filter (result > 0) / nullif(count(*), 0), 0), 6)::double as win_rate, round(coalesce(sum(result), 0)::double, 6) as net from test union all select 'after', count(*), round(coalesce(100.0 * count(*) filter (result > 0) / nullif(count(*), 0), 0), 6)::double, round(coalesce(sum(result), 0)::double, 6) from test where side = 'LONG'")
def q_l3_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the last trades before and after a filter that takes long ones, in place of the model's."""
    trades = classifier.chrono_split(S._model_trades(spark, sf_dir)).filter("part = 'test'")
    return classifier.filter_report(trades.withColumn("prediction", (F.col("side") == "LONG").cast("double")))

"""Queries of signals, event studies, accounting, metrics, robustness, allocation and the classifier."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import accounting, allocation, classifier, metrics, research, robustness, scans, segments, signals
from ..operators import event_study as G
from ..operators import indicators as I
from ..sources.store import written
from . import fixtures as X
from .bar_queries import MONTHS, _prior, daily, hourly
from .registering import Registry

Q = Registry()

_P = "over (partition by symbol, segment_id order by bar_idx"
_PRE = X.DAILY_SEG


def _cells_sql(name: str, grid: signals.Grid | None = None) -> str:
    grid = grid or signals.SIGNALS[name].grid
    rows = ", ".join(f"({k}, {', '.join(f'{float(v)}::double' for v in combo)})" for k, combo in enumerate(product(*grid.values())))
    return f", cells(cell, {', '.join(grid)}) as (values {rows})"


_LAGS = ", ".join(f"lag({c}, {k}) {_P}) as {c}_{k}" for c in ("open", "high", "low", "close") for k in (1, 2, 3, 4, 8, 24, 48))
_FEAT = f""", base as (select *, close / lag(close) {_P}) - 1 as r1, abs(close / lag(close) {_P}) - 1) as ar, (high - low) / lag(close) {_P}) as rp, case when high > low then (close - low) / (high - low) else 0 end as loc, {_LAGS} from seg),
  f1 as (select *, lag(r1) {_P}) as r1_1, case when bar_idx >= 13 then avg(ar) {_prior(12)} end as vol12,
    {', '.join(f"case when bar_idx >= {n} then quantile_cont(volume, 0.5) {_prior(n)} end as mv{n}, case when bar_idx >= {n + 1} then quantile_cont(ar, 0.5) {_prior(n)} end as ma{n}, case when bar_idx >= {n} then quantile_cont(rp, 0.5) {_prior(n)} end as mr{n}, case when bar_idx >= {n} then max(close) {_prior(n)} end as xc{n}" for n in (12, 24, 48))},
    case when bar_idx >= 4 then min(r1) {_prior(3)} end as mn3, case when bar_idx >= 5 then min(r1) {_prior(4)} end as mn4, case when bar_idx >= 24 then max(high) {_prior(24)} end as xh24 from base),
  f2 as (select *, case when bar_idx >= 61 then quantile_cont(vol12, 0.5) {_prior(48)} end as mvol from f1)"""


def _pick(param: str, *pairs: tuple[int, str]) -> str:
    return f"(case {param} " + " ".join(f"when {n} then {c}" for n, c in pairs) + " end)"


_MV = _pick("lookback", (12, "mv12"), (24, "mv24"), (48, "mv48"))
_MVV = _pick("volume_lookback", (24, "mv24"), (48, "mv48"))
#: The rules again, written for the SQL side on columns named there.
_RULES = {
    "hyp0005": f"{_MVV} > 0 and volume >= shock * {_MVV} and r1 >= return_threshold",
    "hyp0007": f"{_MVV} > 0 and volume >= shock * {_MVV} and r1 <= return_threshold",
    "hyp0008": "bar_idx >= 4 and " + _pick("lookback", (24, "ma24"), (48, "ma48")) + " > 0 and close / close_4 - 1 >= threshold and close / close_4 - 1 >= multiplier * " + _pick("lookback", (24, "ma24"), (48, "ma48")),
    "hyp0009": "vol12 <= compression * mvol and close >= " + _pick("breakout_lookback", (12, "xc12"), (24, "xc24")) + " * (1 + breakout)",
    "hyp0010": "r1_1 <= -selloff and r1 <= -selloff and close > open and (volume_multiplier = 0 or volume >= volume_multiplier * mv24)",
    "hyp0011": "r1_1 <= -selloff and close > open and loc >= location",
    "hyp0012": "rp / nullif(" + _pick("lookback", (24, "mr24"), (48, "mr48")) + ", 0) >= multiplier and loc >= location",
    "hyp0013": "bar_idx >= trend_lookback + 1 and close_1 > " + _pick("trend_lookback", (24, "close_24"), (48, "close_48")) + " and r1_1 <= -pullback and close > open and close > " + _pick("trend_lookback", (24, "close_24"), (48, "close_48")) + " and loc >= location",
    "hyp0014": "high_1 <= high_2 and low_1 >= low_2 and close >= high_1 * (1 + breakout) and loc >= location",
    "hyp0015": f"close > open and close_4 < close_1 and {_MV} > 0 and volume >= volume_multiplier * {_MV} and loc >= location",
    "hyp0016": "isodow(ts) - 1 = weekday and close_4 / close_8 - 1 >= trend_threshold and close > open and loc >= location",
    "hyp0017": "open / close_1 - 1 >= gap and close > open and loc >= location",
    "hyp0018": "close_3 < close_2 and close_2 < close_1 and close_1 < close and close / close_3 - 1 >= threshold and loc >= location",
    "hyp0019": "close >= " + _pick("lookback", (12, "xc12"), (24, "xc24")) + f" * (1 + breakout) and {_MV} > 0 and volume <= volume_cap * {_MV} and loc >= location",
    "hyp0020": "hour(ts) = cells.hour and close > open and r1 >= threshold and loc >= location",
    "hyp0021": _pick("k", (3, "mn3"), (4, "mn4")) + " > 0 and close_1 / " + _pick("k", (3, "close_3"), (4, "close_4")) + " - 1 >= threshold and loc <= location",
    "hyp0022": "high > low and close > open and (close - open) / (high - low) >= body_ratio and rp >= range_ratio and (close - open) / close_1 >= body_return",
    "hyp0023": "close / close_24 - 1 >= abnormal and r1 >= threshold",
    "hyp0025": "close_1 < open_1 and close > open and high_1 > low_1 and (open_1 - close_1) / (high_1 - low_1) >= parent_body_ratio and open >= close_1 and close <= open_1 and loc >= location",
}


def _hits_sql(name: str, pre: str = _PRE) -> str:
    return f"{pre}{_FEAT}{_cells_sql(name)}, hits as (select cell, symbol, segment_id, bar_idx from f2 join cells on bar_idx >= 1 and {_RULES[name]})"


def _signal(name: str, hours: bool = False) -> None:
    pre = X.HOURLY_SEG if hours else _PRE

    @Q.add(f"q_F{name[-2:]}", _hits_sql(name, pre) + " select cell, symbol, count(*) as hits, sum(bar_idx)::bigint as idx_sum from hits group by 1, 2" if name in _RULES else None)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        hits = signals.evaluate_grid((hourly if hours else daily)(spark, sf_dir), name)
        return hits.groupBy("cell", "symbol").agg(F.count("*").alias("hits"), F.sum("bar_idx").alias("idx_sum"))


for _name in _RULES:
    _signal(_name, _name in ("hyp0016", "hyp0020"))


_RANK = f", rr as (select *, case when bar_idx >= 23 then (max(high) over w - min(low) over w) / close end as rg, case when bar_idx >= 24 then max(high) {_prior(24)} end as xh from seg window w as (partition by symbol, segment_id order by bar_idx rows 23 preceding)), lr as (select *, lag(rg) {_P}) as latest, list(rg) {_P} rows between 721 preceding and 2 preceding) as refs from rr), ranked as (select *, case when bar_idx >= 744 then len(list_filter(refs, lambda x: x <= latest)) / 720.0::double end as rank from lr)"
_RANK_HITS = f"{_PRE}{_RANK}{_cells_sql('hyp0024')} select cell, symbol, count(*) as hits, sum(bar_idx)::bigint as idx_sum from ranked join cells on rank <= quantile and close >= xh * (1 + buffer) group by 1, 2"


@Q.add("q_F24", _RANK_HITS)
def q_f24(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = signals.evaluate_grid(daily(spark, sf_dir), "hyp0024")
    return hits.groupBy("cell", "symbol").agg(F.count("*").alias("hits"), F.sum("bar_idx").alias("idx_sum"))


def _pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = X.event_bars(spark, sf_dir, True)
    seg = segments.synchronized_segments(bars.filter("symbol = 'click'"), bars.filter("symbol = 'purchase'"), "1 hour")
    return scans.over_blocks(seg, lambda d: d.withColumn("lead_ret", I.ret(1, "lead_close")), 1)


def _pair_of(pre: str, bars: str, lead: str, target: str) -> str:
    """``seg`` of two symbols' bars at equal times and ``pr`` with their returns."""
    seg = X.segments_sql("1 hour").replace("from bars", "from pair").replace("select symbol, ts, open", "select symbol, lead_close, ts, open")
    return f"{pre}, pair as (select p.*, c.close as lead_close from {bars} p join {bars} c on c.symbol = '{lead}' and p.symbol = '{target}' and c.ts = p.ts), {seg}, pr as (select *, close / lag(close) {_P}) - 1 as r1, lead_close / lag(lead_close) {_P}) - 1 as lr from seg)"


_PAIR = _pair_of(f"with {X.TYPE_SQL}", "bars", "click", "purchase")


_PAIR_HITS = _PAIR + _cells_sql("hyp0006") + " select cell, count(*) as hits, sum(bar_idx)::bigint as idx_sum from pr join cells on lr >= lead_threshold and lr - r1 >= gap group by 1"


@Q.add("q_F06", _PAIR_HITS)
def q_f06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.evaluate_grid(_pair(spark, sf_dir), "hyp0006").groupBy("cell").agg(F.count("*").alias("hits"), F.sum("bar_idx").alias("idx_sum"))


def _held(name: str, sql: str) -> None:
    @Q.add(f"q_F{name[-2:]}", sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        held = signals.held_targets(daily(spark, sf_dir), name)
        return held.groupBy("cell", "symbol").agg(F.sum("target").alias("held"), F.sum(F.col("target") * F.col("bar_idx")).alias("idx_sum"))


_SUMS = "select cell, symbol, sum(target)::bigint as held, sum(target * bar_idx)::bigint as idx_sum from held group by 1, 2"
_LATCH = "held as (select *, coalesce(last_value(case when enter then 1 when leave then 0 end ignore nulls) over (partition by cell, symbol, segment_id order by bar_idx), 0) as target from ev)"


def _lagged(n: str, ns: list[int], c: str = "close") -> str:
    return _pick(n, *[(k, f"lag({c}, {k}) {_P})") for k in ns])


_held("hyp0001", f"{_PRE}{_cells_sql('hyp0001')}, lg as (select *, {', '.join(f'lag(close, {k}) {_P}) as c{k}' for k in (12, 24, 36, 120, 168, 216))} from seg), held as (select *, coalesce(close > {_pick('lookback', (120, 'c120'), (168, 'c168'), (216, 'c216'))} and close > {_pick('confirmation', (12, 'c12'), (24, 'c24'), (36, 'c36'))}, false)::int as target from lg cross join cells) {_SUMS}")
_sma = lambda ns: ", ".join(f"case when bar_idx >= {n - 1} then avg(close) {_P} rows {n - 1} preceding) end as s{n}" for n in ns)
_held("hyp0002", f"{_PRE}{_cells_sql('hyp0002')}, sm as (select *, {_sma((36, 48, 60))} from seg), dv as (select *, close / {_pick('lookback', (36, 's36'), (48, 's48'), (60, 's60'))} - 1 as dev from sm cross join cells), ev as (select *, dev <= entry as enter, dev >= exit as leave from dv), {_LATCH} {_SUMS}")
_held(
    "hyp0003",
    f"{_PRE}{_cells_sql('hyp0003')}, ex as (select *, {', '.join(f'max(close) {_prior(n)} as mx{n}, min(close) {_prior(n)} as mi{n}, (max(high) {_P} rows {n - 1} preceding) - min(low) {_P} rows {n - 1} preceding)) / avg(close) {_P} rows {n - 1} preceding) as nr{n}' for n in (18, 24, 30))} from seg), "
    f"ev as (select *, bar_idx >= greatest(lookback, range_lookback) and close > {_pick('lookback', (18, 'mx18'), (24, 'mx24'), (30, 'mx30'))} and {_pick('range_lookback', (18, 'nr18'), (24, 'nr24'), (30, 'nr30'))} >= threshold as enter, bar_idx >= greatest(lookback, range_lookback) and close < {_pick('lookback', (18, 'mi18'), (24, 'mi24'), (30, 'mi30'))} as leave from ex cross join cells), {_LATCH} {_SUMS}",
)
_EMAS = ", ".join(f"s.close * (2.0::double / {n + 1}) + e.e{n} * (1 - 2.0::double / {n + 1}) as e{n}" for n in (160, 200, 240))
_held(
    "hyp0004",
    f"{_PRE}{_cells_sql('hyp0004')}, em as (with recursive e as (select symbol, segment_id, bar_idx, close as e160, close as e200, close as e240 from seg where bar_idx = 0 union all select s.symbol, s.segment_id, s.bar_idx, {_EMAS} from e join seg s on s.symbol = e.symbol and s.segment_id = e.segment_id and s.bar_idx = e.bar_idx + 1) select * from e), "
    f"x1 as (select seg.*, e160, e200, e240, {_sma((18, 24, 30))} from seg join em using (symbol, segment_id, bar_idx)), x2 as (select *, lag(close) {_P}) as c1, {', '.join(f'lag(s{n}) {_P}) as p{n}' for n in (18, 24, 30))}, {', '.join(f'lag(e{a}, {b}) {_P}) as l{a}_{b}' for a in (160, 200, 240) for b in (12, 24, 36))} from x1), "
    f"x3 as (select *, {_pick('ema', (160, 'e160'), (200, 'e200'), (240, 'e240'))} as e, {_pick('ema * 100 + slope', *[(a * 100 + b, f'l{a}_{b}') for a in (160, 200, 240) for b in (12, 24, 36)])} as el, {_pick('trigger', (18, 's18'), (24, 's24'), (30, 's30'))} as s, {_pick('trigger', (18, 'p18'), (24, 'p24'), (30, 'p30'))} as sp from x2 cross join cells where bar_idx >= greatest(ema - 1, slope + trigger - 1)), "
    f"ev as (select *, e > el and close > e and c1 <= sp and close > s as enter, close < s or not (e > el and close > e) as leave from x3), held0 as (select 1), {_LATCH} select c.cell, y.symbol, coalesce(sum(target), 0)::bigint as held, coalesce(sum(target * bar_idx), 0)::bigint as idx_sum from cells c cross join (select distinct symbol from seg) y left join held h on h.cell = c.cell and h.symbol = y.symbol group by 1, 2",
)


_DAYW = "over (partition by symbol, ts::date order by ts rows unbounded preceding)"
_TRIG = f"{X.HOURLY_SEG}, vw as (select *, (high + low + close) / 3 as typ, sum((high + low + close) / 3 * volume) {_DAYW} / sum(volume) {_DAYW} as vwap, case when count(*) over v20 = 20 then avg(volume) over v20 end as vm from seg window v20 as (partition by symbol order by ts rows 19 preceding)), vs as (select *, sqrt(sum(power(typ - vwap, 2) * volume) {_DAYW} / sum(volume) {_DAYW}) as std from vw), trig as (select *, coalesce(high > vwap + std and close < vwap + std and volume > vm, false) as short, coalesce(low < vwap - std and close > vwap - std and volume > vm, false) as long from vs)"


@Q.add("q_F26", _TRIG + " select ts, short, long from trig")
def q_f26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.vwap_triggers(X.event_bars(spark, sf_dir), 1.0).select("ts", "short", "long")


SHOCK = {"volume_lookback": [24, 48], "shock": [1.2, 1.5], "return_threshold": [0.05, 0.2]}


#: The registered cycles and their numbers of cells.
CYCLES = (("next", ("hyp0005", "hyp0006", "hyp0007"), 45), ("2", ("hyp0008", "hyp0009", "hyp0010"), 45), ("3", ("hyp0011", "hyp0012", "hyp0013"), 33), ("4", ("hyp0014", "hyp0015", "hyp0016"), 26), ("5", ("hyp0017", "hyp0018", "hyp0019"), 28), ("6", ("hyp0020", "hyp0021", "hyp0022"), 40), ("7", ("hyp0023", "hyp0024", "hyp0025"), 28))
_GRIDS = "".join(_cells_sql(n).replace("cells(", f"g_{n}(", 1) for _, names, _ in CYCLES for n in names)
_COUNTED = " union all ".join(f"select '{cycle}' as cycle, '{n}' as hypothesis, cell from g_{n}" for cycle, names, _ in CYCLES for n in names)
_FIRED = " union all ".join(f"select '{n}' as hypothesis, cell, count(*) as hits from f2 join g_{n} as cells on bar_idx >= 1 and {_RULES[n]} group by cell" for _, names, _ in CYCLES for n in names if n in _RULES)
#: The registered pair and rank signals have tables of their own.
_FIRED += f" union all select 'hyp0006', cell, hits from ({_PAIR_HITS}) union all select 'hyp0024', cell, sum(hits)::bigint from ({_RANK_HITS}) group by cell"


@Q.add("q_F31_F33", f"{_PRE}{_FEAT}{_GRIDS}, every as ({_COUNTED}), fired as ({_FIRED}) select cycle, count(*) as cells, count(distinct (hypothesis, cell)) as numbers, coalesce(sum(hits), 0)::bigint as hits from every left join fired using (hypothesis, cell) group by 1")
def q_f31(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All registered grids with their counts asserted, and how often their cells fire: the pair signal on the synchronised pair, the others on all daily bars."""
    every = None
    for cycle, names, n in CYCLES:
        own = None
        for name in names:
            grid = signals.param_grid(spark, signals.SIGNALS[name].grid).select(F.lit(cycle).alias("cycle"), F.lit(name).alias("hypothesis"), "cell")
            own = grid if own is None else own.union(grid)
        own = signals.assert_cells(own, n)
        every = own if every is None else every.union(own)
    hits = signals.evaluate_grids(daily(spark, sf_dir), tuple(n for _, names, _ in CYCLES for n in names if n != "hyp0006"))
    pair = signals.evaluate_grid(_pair(spark, sf_dir), "hyp0006").select(F.lit("hyp0006").alias("hypothesis"), "cell")
    fired = hits.select("hypothesis", "cell").union(pair).groupBy("hypothesis", "cell").agg(F.count("*").alias("hits"))
    both = every.join(fired, ["hypothesis", "cell"], "left")
    return both.groupBy("cycle").agg(F.count("*").alias("cells"), F.count_distinct("hypothesis", "cell").alias("numbers"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))


_SHOCK_HITS = f"{_PRE}{_FEAT}{_cells_sql('hyp0005', SHOCK)}, hits as (select cell, symbol, segment_id, bar_idx from f2 join cells on bar_idx >= 1 and {_RULES['hyp0005']})"


@Q.add("q_F34", _hits_sql("hyp0005") + " select c.cell, count(h.cell) as events, count(h.cell) = 0 as unsatisfied from cells c left join hits h using (cell) group by 1")
def q_f34(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = signals.param_grid(spark, signals.SIGNALS["hyp0005"].grid)
    return signals.zero_event_cells(cells, signals.evaluate_grid(daily(spark, sf_dir), "hyp0005")).select("cell", "events", "unsatisfied")


# Event study


def study(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(segmented daily bars, volume-shock events of all cells, cost cases and delays)."""
    seg = written(daily(spark, sf_dir), "bars")
    return seg, written(G.run_events(signals.evaluate_grid(seg, "hyp0005", SHOCK), seg, G.stress_grid(spark)), "events")


_STUDY_OF_HITS = """, stress(cost, fee, slip, delay) as (select c.*, d from (values ('baseline', 0.001::double, 0.0005::double), ('stress_1', 0.0015, 0.001), ('stress_2', 0.0025, 0.0015)) c(cost, fee, slip), (values (1), (2)) d(d)),
  lastbar as (select symbol, segment_id, max(bar_idx) as lb from seg group by 1, 2),
  cand as (select h.cell, h.symbol, h.segment_id, h.bar_idx, d.delay from hits h join (select distinct delay from stress) d on true join lastbar l on l.symbol = h.symbol and l.segment_id = h.segment_id and h.bar_idx + d.delay <= lb),
  walk as (with recursive w as (select cell, symbol, segment_id, delay, min(bar_idx) as bar_idx from cand group by 1, 2, 3, 4
    union all select cell, symbol, segment_id, delay, nxt from (select w.*, (select min(c.bar_idx) from cand c where c.cell = w.cell and c.symbol = w.symbol and c.segment_id = w.segment_id and c.delay = w.delay and c.bar_idx > w.bar_idx + w.delay) as nxt from w) where nxt is not null) select * from w),
  ev as (select w.cell, w.symbol, w.segment_id, w.bar_idx, w.delay, s.cost, w.bar_idx + w.delay as entry_idx, b.ts as entry_ts, b.ts as exit_ts, b.close * (1 - slip) / (b.open * (1 + slip)) * (1 - fee) * (1 - fee) - 1 as ret
    from walk w join seg b on b.symbol = w.symbol and b.segment_id = w.segment_id and b.bar_idx = w.bar_idx + w.delay join stress s on s.delay = w.delay)"""
_STUDY = _SHOCK_HITS + _STUDY_OF_HITS
KEYS = ["cell", "symbol", "cost", "delay"]
_K = "cell, symbol, cost, delay"
_COMP = "exp(sum(ln(1 + ret))) - 1"


@Q.add("q_G1", _STUDY.replace("join seg b on", "join seg b on") + " select distinct cell, symbol, segment_id, delay, bar_idx from ev")
def q_g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study(spark, sf_dir)[1].select("cell", "symbol", "segment_id", "delay", "bar_idx").distinct()


@Q.add("q_G2_G3_G4", _STUDY + f" select {_K}, segment_id, bar_idx, entry_idx, round(ret, 6) as ret from ev")
def q_g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study(spark, sf_dir)[1].select(*KEYS, "segment_id", "bar_idx", "entry_idx", "ret")


@Q.add("q_G5", _STUDY + f" select {_K}, segment_id, bar_idx, round(sum(ln(1 + ret)) over (partition by {_K}, segment_id order by bar_idx), 6) as log_equity from ev")
def q_g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.event_equity(study(spark, sf_dir)[1], [*KEYS, "segment_id"]).select(*KEYS, "segment_id", "bar_idx", F.ln("equity").alias("log_equity"))


_BENCH = "select symbol, segment_id, count(*) as bars, arg_min(open, bar_idx) as o, arg_max(close, bar_idx) as c from seg group by 1, 2 having count(*) >= 2"


@Q.add("q_G6", f"{X.GAP_SEG} select symbol, segment_id, bars, round(c * (1 - 0.0005) / (o * (1 + 0.0005)) * 0.999 * 0.999 - 1, 6) as ret from ({_BENCH})")
def q_g6(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments.continuous_segments(X.gap_bars(spark, sf_dir), "1 day")
    return G.segment_benchmark(seg, 0.001, 0.0005).select("symbol", "segment_id", "bars", "ret")


@Q.add("q_G7_H6", f"{X.GAP_SEG} select symbol, segment_id, round(c * (1 - 0.0005) / (o * (1 + 0.0005)) * 0.999 * 0.999 - 1, 6) as ret from ({_BENCH}) where bars >= 5")
def q_g7(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments.continuous_segments(X.gap_bars(spark, sf_dir), "1 day")
    return G.eligible_benchmark(seg, segments.min_length(seg, 5), 0.001, 0.0005).select("symbol", "segment_id", "ret")


@Q.add("q_G8", _PAIR + f", fw as (select *, lead(close) {_P}) / close - 1 as nr from pr), cc as (select *, lr >= 0.01 and lr - r1 >= 0.005 as c from fw where bar_idx >= 1 and nr is not null) select count(*) filter (c) as conditional_events, count(*) as control_events, round(avg(nr) filter (c), 6) as conditional_mean, round(avg(nr), 6) as control_mean, round(avg(nr) filter (c) - avg(nr), 6) as difference from cc")
def q_g8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = scans.over_blocks(_pair(spark, sf_dir), lambda d: d.withColumn("r1", I.ret(1)), 1)
    return G.conditional_control(pair, (F.col("lead_ret") >= 0.01) & (F.col("lead_ret") - F.col("r1") >= 0.005), 1)


_TOUCH = _TRIG + """, n as (select *, row_number() over (partition by symbol order by ts) - 1 as i, count(*) over (partition by symbol) as cnt from trig), t as (select *, case when short then high - close else close - low end as risk from n where (short or long) and i < cnt - 20),
  o as (select t.symbol, t.ts, t.short, min(case when (t.short and f.high >= t.high) or (not t.short and f.low <= t.low) then f.i * 2 when (t.short and f.low <= t.close - 2 * t.risk) or (not t.short and f.high >= t.close + 2 * t.risk) then f.i * 2 + 1 end) as hit from t join n f on f.symbol = t.symbol and f.i > t.i and f.i < t.i + 20 where t.risk > 0 group by 1, 2, 3),
  trades as (select symbol, ts, case when short then 'SHORT' else 'LONG' end as side, case when hit % 2 = 0 then -1.0 else 2.0 end as result from o where hit is not null)"""


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.first_touch(signals.vwap_triggers(X.event_bars(spark, sf_dir), 1.0))


@Q.add("q_G9", _TOUCH + " select ts, side, result::double as result from trades")
def q_g9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trades(spark, sf_dir).select("ts", "side", "result")


@Q.add("q_G10", _TOUCH + " select count(*) as trades, count(*) filter (result > 0) as wins, coalesce(sum(result), 0)::double as net, round(100.0 * count(*) filter (result > 0) / nullif(count(*), 0), 6)::double as win_rate from trades")
def q_g10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.bracket_summary(_trades(spark, sf_dir))


@Q.add("q_G10_last", _TOUCH + " select ts, side, result::double as result from trades order by ts desc limit 5")
def q_g10_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.last_trades(_trades(spark, sf_dir)).select("ts", "side", "result")


# Accounting

SEG = ["symbol", "segment_id"]


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of the momentum signal on daily bars."""
    return signals.held_targets(daily(spark, sf_dir), "hyp0001", {"lookback": [24], "confirmation": [12]})


_TGT = f"{_PRE}, tg as (select 0 as cell, symbol, segment_id, bar_idx, ts, open, close, coalesce(close > lag(close, 24) {_P}) and close > lag(close, 12) {_P}), false)::int as target from seg)"
_BINARY = _TGT + f""", d as (select *, coalesce(lag(target) {_P}), 0) as wanted from tg),
  acc as (with recursive a as (select symbol, segment_id, bar_idx, 1000.0::double as cash, 0.0::double as units, 0.0::double as cost, 0.0::double as entry, null::double as pnl, 1000.0::double as equity from d where bar_idx = 0
   union all select d.symbol, d.segment_id, d.bar_idx,
     case when d.wanted = 1 and a.units = 0 then 0.0 when d.wanted = 0 and a.units > 0 then a.cash + a.units * d.open * 0.9995 * 0.999 else a.cash end,
     case when d.wanted = 1 and a.units = 0 then a.cash / 1.001 / (d.open * 1.0005) when d.wanted = 0 then 0.0 else a.units end,
     case when d.wanted = 1 and a.units = 0 then a.cash - a.cash / 1.001 when d.wanted = 0 and a.units > 0 then a.units * d.open * 0.9995 * 0.001 else 0.0 end,
     case when d.wanted = 1 and a.units = 0 then a.cash else a.entry end,
     case when d.wanted = 0 and a.units > 0 then a.units * d.open * 0.9995 * 0.999 - a.entry end,
     case when d.wanted = 1 and a.units = 0 then a.cash / 1.001 / (d.open * 1.0005) * d.close when d.wanted = 0 and a.units > 0 then a.cash + a.units * d.open * 0.9995 * 0.999 else a.cash + a.units * d.close end
   from a join d on d.symbol = a.symbol and d.segment_id = a.segment_id and d.bar_idx = a.bar_idx + 1) select * from a)"""


@Q.add("q_H1", _TGT + f" select symbol, segment_id, bar_idx, coalesce(lag(target, 2) {_P}), 0) as wanted from tg")
def q_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounting.delayed_target(_targets(spark, sf_dir), 2).select("symbol", "segment_id", "bar_idx", "wanted")


def _relative(c: str) -> F.Column:
    """Values of any size to 6 figures: logs of what may grow without bound."""
    return F.ln(F.col(c))


@Q.add("q_H2", _BINARY + " select symbol, segment_id, bar_idx, round(ln(equity), 6) as log_equity, round(pnl / (equity - pnl), 6) as trade_return, round(cost / equity, 6) as cost_share from acc")
def q_h2(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = accounting.binary_accounting(_targets(spark, sf_dir))
    return b.select("symbol", "segment_id", "bar_idx", _relative("equity").alias("log_equity"), (F.col("trade_pnl") / (F.col("equity") - F.col("trade_pnl"))).alias("trade_return"), (F.col("cost") / F.col("equity")).alias("cost_share"))


def _fills(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Daily bars whose target is larger the nearer the close is to the low, in quarters, and the fills."""
    df = daily(spark, sf_dir)
    low = 1 - F.round(C.close_location(F.col("high"), F.col("low"), F.col("close")) * 4) / 4
    df = written(df.withColumns({"cell": F.lit(0).cast("bigint"), "target": low}), "targets")
    return df, written(accounting.fractional_fills(df), "fills")


_FRACTION = f"""{_PRE}, tg as (select symbol, segment_id, bar_idx, open, close, 1 - round((case when high > low then (close - low) / (high - low) else 0 end) * 4) / 4 as target from seg),
  d as (select *, lag(target) {_P}) as wanted from tg),
  w as (with recursive a as (select symbol, segment_id, bar_idx, 1000.0::double as cash, 0.0::double as units, 0.0::double as traded, 0.0::double as price, 0.0::double as fee, 1000.0::double as equity from d where bar_idx = 0
    union all select symbol, segment_id, bar_idx, cash - q * p - abs(q) * p * 0.001, case when q < 0 and wanted = 0 then 0.0 else units + q end, q, p, abs(q) * p * 0.001, cash - q * p - abs(q) * p * 0.001 + (case when q < 0 and wanted = 0 then 0.0 else units + q end) * close
    from (select *, case when still then 0.0 when move > 0 then move / 1.001 / p when wanted = 0 then -units else -least(units, -move / p) end as q
      from (select *, open * (case when move > 0 then 1.0005 else 0.9995 end) as p, abs(move) <= 1e-12 * (cash + units * open) or (move < 0 and units <= 0) as still
        from (select d.*, a.cash, a.units, (a.cash + a.units * d.open) * d.wanted - a.units * d.open as move from a join d on d.symbol = a.symbol and d.segment_id = a.segment_id and d.bar_idx = a.bar_idx + 1)))) select * from a),
  fills as (select symbol, segment_id, bar_idx, case when traded > 0 then 'buy' else 'sell' end as side, abs(traded) as qty, price, fee from w where traded <> 0),
  cum as (select *, sum(qty) over (partition by symbol, segment_id, side order by bar_idx) as hi from fills),
  met as (select b.symbol, b.segment_id, b.bar_idx as buy_idx, s.bar_idx as sell_idx, least(b.hi, s.hi) - greatest(b.hi - b.qty, s.hi - s.qty) as q, b.qty as bq, b.price as bp, b.fee as bf, s.qty as sq, s.price as sp, s.fee as sf from cum b join cum s on b.symbol = s.symbol and b.segment_id = s.segment_id and b.side = 'buy' and s.side = 'sell' and b.hi - b.qty < s.hi and s.hi - s.qty < b.hi),
  lots as (select symbol, segment_id, buy_idx, sell_idx, q, q * bp + bf * q / bq as cost, q * sp - sf * q / sq as proceeds from met where q > 1e-9 * least(bq, sq))"""


@Q.add("q_H3", _FRACTION + " select symbol, segment_id, bar_idx, side, round(ln(qty), 6) as log_qty, round(ln(price), 6) as log_price, round(ln(fee), 6) as log_fee from fills")
def q_h3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fills(spark, sf_dir)[1].select(*SEG, "bar_idx", "side", F.ln("qty").alias("log_qty"), F.ln("price").alias("log_price"), F.ln("fee").alias("log_fee"))


@Q.add("q_H4", _FRACTION + " select symbol, segment_id, buy_idx, sell_idx, round(proceeds / cost, 6) as gain, round(ln(cost), 5) as log_cost from lots")
def q_h4(spark: SparkSession, sf_dir: str) -> DataFrame:
    lots = accounting.fifo_match(_fills(spark, sf_dir)[1])
    return lots.select(*SEG, "buy_idx", "sell_idx", (F.col("proceeds") / F.col("cost")).alias("gain"), F.round(F.ln("cost"), 5).alias("log_cost"))


@Q.add("q_H5", _FRACTION + """, fin as (select symbol, segment_id, arg_max(w.equity, w.bar_idx) as equity, arg_max(w.units, w.bar_idx) * arg_max(d.close, d.bar_idx) as held, sum(w.fee) as fees, sum(w.traded * w.price + w.fee) filter (w.traded > 0) as bought from w join d using (symbol, segment_id, bar_idx) group by 1, 2),
  sold as (select symbol, segment_id, sum(proceeds - cost) as realized, sum(cost) as closed from lots group by 1, 2)
  select symbol, segment_id, round(ln(equity), 6) as log_equity, round(coalesce(fees, 0) / equity, 4) as fees, round(coalesce(realized, 0) / equity, 4) as realized, round((held - (coalesce(bought, 0) - coalesce(closed, 0))) / equity, 4) as unrealized from fin left join sold using (symbol, segment_id)""")
def q_h5(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, fills = _fills(spark, sf_dir)
    t = accounting.account_totals(accounting.equity_curve(df, fills), fills, accounting.fifo_match(fills))
    return t.select(*SEG, F.ln("final_equity").alias("log_equity"), *[F.round(F.col(c) / F.col("final_equity"), 4).alias(c) for c in ("fees", "realized", "unrealized")])


# Metrics


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(accounting.binary_accounting(_targets(spark, sf_dir)), "curve")


def _metric(name: str, sql: str, build) -> None:  # noqa: ANN001
    @Q.add(name, _BINARY + ", cv as (select *, close0 as close, max(equity) over (partition by symbol, segment_id order by bar_idx) as peak, equity / lag(equity) over (partition by symbol, segment_id order by bar_idx) - 1 as r from (select acc.*, d.close as close0, d.wanted from acc join d using (symbol, segment_id, bar_idx))) " + sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(_curve(spark, sf_dir))


_S = "symbol, segment_id"
_metric("q_I1", f"select {_S}, round(ln(arg_max(equity, bar_idx) / arg_min(equity, bar_idx)), 6) as log_return from cv group by 1, 2", lambda c: metrics.total_return(c, SEG).select(*SEG, F.ln(1 + F.col("total_return")).alias("log_return")))
_metric("q_I2", f"select {_S}, count(*) as trades, round(avg((t > 0)::int), 6) as win_rate, round(coalesce(avg(t) filter (t > 0), 0), 6) as average_win, round(coalesce(avg(t) filter (t < 0), 0), 6) as average_loss, round(avg((t > 0)::int) * coalesce(avg(t) filter (t > 0), 0) + avg((t < 0)::int) * coalesce(avg(t) filter (t < 0), 0), 6) as expectancy, round(case when sum(t) filter (t < 0) < 0 then coalesce(sum(t) filter (t > 0), 0) / -sum(t) filter (t < 0) end, 6) as profit_factor from (select *, pnl / (equity - pnl) as t from cv where pnl is not null) group by 1, 2", lambda c: metrics.trade_stats(c.filter("trade_pnl is not null").withColumn("pnl", F.col("trade_pnl") / (F.col("equity") - F.col("trade_pnl"))), SEG))
_metric("q_I3", f"select {_S}, round(max((peak - equity) / peak), 6) as max_drawdown from cv group by 1, 2", lambda c: metrics.max_drawdown(c, SEG))
_metric("q_I4", f"select {_S}, round(case when stddev_pop(r) > 0 then avg(r) / stddev_pop(r) * sqrt(365.0) end, 6) as sharpe from cv group by 1, 2", lambda c: metrics.sharpe(c, SEG, 365))
_metric("q_I5", f"select {_S}, round(case when sum(case when r < 0 then r * r end) > 0 then avg(r) / sqrt(sum(case when r < 0 then r * r end) / count(r)) * sqrt(365.0) end, 6) as sortino from cv group by 1, 2", lambda c: metrics.sortino(c, SEG, 365))
_metric("q_I6", f", tr as (select *, sum((pnl >= 0)::int) over (partition by symbol, segment_id order by bar_idx) as run from cv where pnl is not null) select {_S}, max(n) as losing_streak from (select {_S}, run, count(*) filter (pnl < 0) as n from tr group by 1, 2, 3) group by 1, 2", lambda c: metrics.losing_streak(c.filter("trade_pnl is not null").withColumn("pnl", F.col("trade_pnl")), SEG, "bar_idx"))
_metric("q_I7", f"select {_S}, round(avg(wanted), 6) as exposure from cv group by 1, 2", lambda c: metrics.exposure(c, SEG))
_metric("q_I8", f""", fu as (select {_S}, min(bar_idx) as a from cv where equity < peak group by 1, 2), fr as (select c.symbol, c.segment_id, min(c.bar_idx) as b from cv c join fu on fu.symbol = c.symbol and fu.segment_id = c.segment_id and c.bar_idx > fu.a and c.equity >= c.peak group by 1, 2)
  select s.symbol, s.segment_id, case when a is null then 0 when b is not null then b - a end as recovery_periods from (select distinct {_S} from cv) s left join fu using ({_S}) left join fr using ({_S})""", lambda c: metrics.recovery_periods(c, SEG))
_metric("q_I9", f"select {_S}, max(bar_idx - p) as longest_recovery from (select *, max(case when equity >= peak then bar_idx end) over (partition by symbol, segment_id order by bar_idx) as p from cv) group by 1, 2", lambda c: metrics.longest_recovery(c, SEG))


@Q.add("q_I10", _STUDY + f", eq as (select *, exp(sum(ln(1 + ret)) over (partition by {_K}, segment_id order by bar_idx)) as equity from ev), pk as (select *, greatest(1.0, max(equity) over (partition by {_K}, segment_id order by bar_idx)) as peak from eq), pt as (select *, max(case when equity >= peak then entry_ts end) over (partition by {_K}, segment_id order by bar_idx) as pts from pk) select {_K}, segment_id, round(coalesce(max(case when equity < peak then epoch_us(entry_ts) - epoch_us(pts) end), 0) / 3.6e9, 6) as longest_recovery_hours from pt group by cell, symbol, cost, delay, segment_id")
def q_i10(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [*KEYS, "segment_id"]
    return metrics.longest_recovery_hours(G.event_equity(study(spark, sf_dir)[1], keys), keys, "entry_ts")


@Q.add("q_I11", _STUDY + f" select {_K}, count(*) as events, round(sum(ln(1 + ret)), 6) as log_compound, round(avg(ret), 6) as mean_event_return, round(avg((ret > 0)::int), 6) as positive_fraction from ev group by 1, 2, 3, 4")
def q_i11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.event_stats(study(spark, sf_dir)[1], KEYS).select(*KEYS, "events", F.ln(1 + F.col("compound_return")).alias("log_compound"), "mean_event_return", "positive_fraction")


_SEGS = _STUDY + f", sr as (select {_K}, segment_id, count(*) as events, {_COMP} as sret from ev group by 1, 2, 3, 4, 5), cs as (select {_K}, count(*) as events, {_COMP} as comp from ev group by 1, 2, 3, 4), sm as (select {_K}, avg(sret) as msr, count(*) as nseg from sr group by 1, 2, 3, 4)"


@Q.add("q_I12", _SEGS + f" select {_K}, cs.events, round(asinh(comp), 6) as compound, round(asinh(msr), 6) as mean_segment, nseg as eligible_segments from cs join sm using ({_K})")
def q_i12(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = metrics.cell_summary(study(spark, sf_dir)[1], KEYS)
    return s.select(*KEYS, "events", F.asinh("compound_return").alias("compound"), F.asinh("mean_segment_return").alias("mean_segment"), "eligible_segments")


_metric("q_I13", """, tr as (select symbol, segment_id, ln(arg_max(equity, bar_idx) / arg_min(equity, bar_idx)) as lr, max((peak - equity) / peak) as dd, count(pnl) as n from cv group by 1, 2)
  select symbol, count(*) as segments, round(sum(lr), 6) as log_compound, round(avg((lr > 0)::int), 6) as positive_segment_fraction, round(max(dd), 6) as max_segment_drawdown, sum(n)::bigint as trade_count from tr group by 1""",
        lambda c: metrics.segment_summary(metrics.total_return(c, SEG).join(metrics.max_drawdown(c, SEG), SEG).join(c.groupBy(*SEG).agg(F.count("trade_pnl").alias("trades")), SEG), ["symbol"]).select("symbol", "segments", F.ln(1 + F.col("compound_return")).alias("log_compound"), "positive_segment_fraction", "max_segment_drawdown", "trade_count"))


@Q.add("q_I14", f"with {X.DAILY_SQL}, a as (select ts::date as date, close as a from bars where symbol = 'A' and ts >= date '1996-01-01' and close > 0), b as (select ts::date as date, close as b from bars where symbol = 'N' and ts >= date '1996-01-01' and close > 0), j as (select *, a / max(a) over (order by date) - 1 as da, b / max(b) over (order by date) - 1 as db from a join b using (date)) select count(*) as trading_days, 'ok' as status, min(date) as start, max(date) as \"end\", round(arg_max(a, date) / arg_min(a, date) - 1, 6) as account_return, round(arg_max(b, date) / arg_min(b, date) - 1, 6) as benchmark_return, round(min(da), 6) as account_max_drawdown, round(min(db), 6) as benchmark_max_drawdown, round(arg_max(a, date) / arg_min(a, date) - arg_max(b, date) / arg_min(b, date), 6) as difference from j")
def q_i14(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = X.daily_bars(spark, sf_dir).select("symbol", F.to_date("ts").alias("date"), F.col("close").alias("value"))
    return metrics.account_vs_benchmark(bars.filter("symbol = 'A'"), bars.filter("symbol = 'N'"), "1996-01-01")


_metric("q_I15", f"select {_S}, null::varchar as error from cv group by 1, 2", lambda c: metrics.validate_metrics_input(c, SEG))


# Robustness


def summary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(segmented bars, events, cell summaries)."""
    seg, ev = study(spark, sf_dir)
    return seg, ev, written(metrics.cell_summary(ev, KEYS), "summary")


_HS = ["symbol", "cost", "delay"]
_J = _SEGS + f", su as (select {_K}, cs.events, comp, msr, nseg from cs join sm using ({_K}))"
_OK = "msr > 0 and comp > 0"


@Q.add("q_J1", _J + " select symbol, cost, delay, count(*) as valid_cells, round(avg((msr > 0)::int), 6) as positive_fraction, round(asinh(quantile_cont(comp, 0.5)), 6) as median_compound, avg((msr > 0)::int) >= 0.6 and quantile_cont(comp, 0.5) > 0 as pass from su group by 1, 2, 3")
def q_j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = robustness.param_neighborhood(summary(spark, sf_dir)[2], _HS)
    return p.select(*_HS, "valid_cells", "positive_fraction", F.asinh("median_compound_return").alias("median_compound"), "pass")


@Q.add("q_J2", _J + f" select cell, symbol, {_OK} as pass from su where cost = 'stress_2' and delay = 1")
def q_j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robustness.cost_stress(summary(spark, sf_dir)[2], ["cell", "symbol"])


@Q.add("q_J3", _J + f" select cell, symbol, {_OK} as pass from su where cost = 'baseline' and delay = 2")
def q_j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robustness.timing_stress(summary(spark, sf_dir)[2], ["cell", "symbol"])


_REG = _STUDY + f", lab as (select symbol, segment_id, bar_idx, case when m > 0.1 then 'bull' when m < -0.1 then 'bear' else 'neutral' end as regime from (select *, close / lag(close, 168) {_P}) - 1 as m from seg) where m is not null), rb as (select symbol, regime, count(*) as bars from lab group by 1, 2), rg as (select {_K}, regime, count(*) as events, {_COMP} as comp from ev join lab using (symbol, segment_id, bar_idx) group by cell, symbol, cost, delay, regime), rc as (select k.cell, k.symbol, k.cost, k.delay, rb.regime, rb.bars, coalesce(rg.events, 0) as events, coalesce(rg.comp, 0) as comp from (select distinct {_K} from ev) k join rb using (symbol) left join rg on rg.cell = k.cell and rg.symbol = k.symbol and rg.cost = k.cost and rg.delay = k.delay and rg.regime = rb.regime)"


@Q.add("q_J4", _REG + f" select {_K}, count(*) filter (bars >= 100) as qualifying, count(*) filter (bars >= 100 and comp > 0) as positive, count(*) filter (bars >= 100) < 2 or count(*) filter (bars >= 100 and comp > 0) >= 2 as pass from rc group by 1, 2, 3, 4")
def q_j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg, ev = study(spark, sf_dir)
    return robustness.regime_events(ev, seg, KEYS)


@Q.add("q_J5", _REG + f" select {_K}, count(*) filter (events >= 100) as qualifying, count(*) filter (events >= 100 and comp > 0) as positive, count(*) filter (events >= 100 and comp > 0) >= 2 as pass from rc group by 1, 2, 3, 4")
def q_j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg, ev = study(spark, sf_dir)
    return robustness.regime_events(ev, seg, KEYS, 100, "strict")


_metric("q_J6", f", lb as (select *, close / lag(close, 168) over (partition by symbol, segment_id order by bar_idx) - 1 as m from cv) select symbol, case when m > 0.1 then 'bull' when m < -0.1 then 'bear' else 'neutral' end as regime, count(*) as bars, round(asinh(exp(sum(ln(1 + r))) - 1), 6) as compound from lb where m is not null and r is not null group by 1, 2", lambda c: robustness.regime_equity(c, ["symbol"]).select("symbol", "regime", "bars", F.asinh("return").alias("compound")))
_LOO = _SEGS + f", al as (select k.*, s.segment_id from (select distinct {_K} from sr) k join (select distinct symbol, segment_id from seg) s using (symbol)), lo as (select al.*, coalesce(ln(1 + sret), 0) as l from al left join sr using ({_K}, segment_id)), tt as (select *, sum(l) over (partition by {_K}) - l as rest from lo)"


@Q.add("q_J7", _LOO + f" select {_K}, count(*) as variants, round(avg((exp(rest) - 1 > 1e-12)::int), 6) as pass_fraction, avg((exp(rest) - 1 > 1e-12)::int) >= 0.75 as pass from tt group by 1, 2, 3, 4")
def q_j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg, ev = study(spark, sf_dir)
    return robustness.leave_one_out(metrics.segment_returns(ev, KEYS), KEYS, seg).drop("minimum")


@Q.add("q_J8", _SEGS + f", t8 as (select *, sum(ln(1 + sret)) over (partition by {_K}) - ln(1 + sret) as rest from sr) select {_K}, case when count(*) >= 2 then round(min(rest), 6) end as log_minimum from t8 group by 1, 2, 3, 4")
def q_j8(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = robustness.loo_min(metrics.segment_returns(study(spark, sf_dir)[1], KEYS), KEYS)
    return m.select(*KEYS, F.ln(1 + F.col("minimum")).alias("log_minimum"))


@Q.add("q_J9", _SEGS + f" select {_K}, round(max(ln(1 + sret)) filter (sret > 0) / nullif(sum(ln(1 + sret)) filter (sret > 0), 0), 6) as max_share from sr group by 1, 2, 3, 4")
def q_j9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robustness.log_concentration(metrics.segment_returns(study(spark, sf_dir)[1], KEYS), KEYS)


def _top(variant: str, where: str, n: str) -> None:
    @Q.add(f"q_J10_{variant}", _STUDY + f", tk as (select *, row_number() over (partition by {_K} order by ret desc) as k, count(*) over (partition by {_K}) as n from ev where {where}) select {_K}, round(sum(greatest(ret, 0)) filter (k <= {n}) / nullif(sum(greatest(ret, 0)), 0), 6) as top_share from tk group by 1, 2, 3, 4")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return robustness.top_share(study(spark, sf_dir)[1], KEYS, variant)


_top("ceil", "ret > 0", "greatest(1, ceil(n * 0.1))")
_top("tenth", "ret > 0", "greatest(1, (n + 9) // 10)")
_top("all", "true", "ceil(n * 0.1)")
_DD = _SEGS + f", eq as (select *, exp(sum(ln(1 + ret)) over (partition by {_K}, segment_id order by bar_idx)) as equity from ev), pk as (select *, greatest(1.0, max(equity) over (partition by {_K}, segment_id order by bar_idx)) as peak from eq), dd as (select {_K}, max((peak - equity) / peak) as mdd from pk group by 1, 2, 3, 4), ws as (select {_K}, min(sret) as worst, sum(events) as n from sr group by 1, 2, 3, 4)"


def _drawdowns(ev: DataFrame) -> DataFrame:
    by = [*KEYS, "segment_id"]
    per = metrics.max_drawdown(G.event_equity(ev, by), by, start=1.0)
    return per.groupBy(*KEYS).agg(F.max("max_drawdown").alias("max_drawdown"))


_RECOVERY = f""", pt as (select *, max(case when equity >= peak then entry_ts end) over (partition by {_K}, segment_id order by bar_idx) as pts from pk), rh as (select {_K}, segment_id, coalesce(max(case when equity < peak then epoch_us(entry_ts) - epoch_us(pts) end), 0) / 3.6e9 as entry_hours,
    greatest(coalesce(max(case when equity < peak then epoch_us(entry_ts) - epoch_us(pts) end), 0), coalesce(arg_max(case when equity < peak then epoch_us(last_ts) - epoch_us(pts) end, bar_idx), 0), coalesce(max(case when bar_idx = last_event and equity < peak then epoch_us(last_ts) - epoch_us(pts) end), 0)) / 3.6e9 as exit_hours
    from (select pt.*, l.last_ts, max(bar_idx) over (partition by {_K}, pt.segment_id) as last_event from pt join (select symbol, segment_id, max(ts) as last_ts from seg group by 1, 2) l using (symbol, segment_id)) group by 1, 2, 3, 4, 5),
  rk as (select {_K}, max(entry_hours) as recovery, max(exit_hours) as exit_recovery from rh group by 1, 2, 3, 4), du as (select symbol, sum(floor((epoch(b) - epoch(a)) / 3600) + 1)::bigint as duration, sum(n)::bigint as bars from (select symbol, segment_id, min(ts) as a, max(ts) as b, count(*) as n from seg group by 1, 2) group by 1)""".replace(" coalesce(arg_max(case when equity < peak then epoch_us(last_ts) - epoch_us(pts) end, bar_idx), 0),", "")


@Q.add("q_J11", _DD + _RECOVERY + f" select {_K}, n::bigint as events, round(mdd, 6) as max_drawdown, round(least(worst, 0), 6) as worst_segment_return, round(recovery, 6) as recovery, duration, n > 0 and mdd < 0.7 and least(worst, 0) >= -0.5 and recovery <= 0.5 * duration as pass from dd join ws using ({_K}) join rk using ({_K}) join du using (symbol)")
def q_j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg, ev = study(spark, sf_dir)
    return robustness.drawdown_gate(robustness.drawdown_recovery(ev, seg, KEYS))


@Q.add("q_J12", _DD + f", tk as (select *, row_number() over (partition by {_K} order by ret desc) as k, count(*) over (partition by {_K}) as n from ev where ret > 0), ts_ as (select {_K}, sum(ret) filter (k <= greatest(1, ceil(n * 0.1))) / sum(ret) as top from tk group by 1, 2, 3, 4), mx as (select {_K}, max(ln(1 + sret)) filter (sret > 0) / nullif(sum(ln(1 + sret)) filter (sret > 0), 0) as share from sr group by 1, 2, 3, 4) select {_K}, round(asinh(worst), 6) as worst, n::bigint as eligible_events, round(share, 6) as max_share, round(top, 6) as top_share, round(mdd, 6) as max_drawdown from ws left join mx using ({_K}) left join ts_ using ({_K}) left join dd using ({_K})")
def q_j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = study(spark, sf_dir)[1]
    out = robustness.concentration_drawdown(metrics.segment_returns(ev, KEYS), ev, KEYS, _drawdowns(ev))
    return out.select(*KEYS, F.asinh("worst_segment_return").alias("worst"), "eligible_events", "max_share", "top_share", "max_drawdown")


@Q.add("q_J13", _J + f" select cell, cost, delay, count(*) as symbols, bool_and({_OK}) as pass from su group by 1, 2, 3")
def q_j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robustness.transferability(summary(spark, sf_dir)[2], ["cell", "cost", "delay"])


_CONTROL = f", fw as (select *, lead(close) {_P}) / close - 1 as nr from pr), c0 as (select avg(nr) as m from fw where bar_idx >= 1 and nr is not null), cd as (select cell, avg(nr) - (select m from c0) as difference from hits join fw using (symbol, segment_id, bar_idx) where nr is not null group by 1)"
_LEAD_HITS = _PAIR + _cells_sql("hyp0006") + ", hits as (select cell, symbol, segment_id, bar_idx from pr join cells on bar_idx >= 1 and lr >= lead_threshold and lr - r1 >= gap)"


@Q.add("q_J13_control", _LEAD_HITS + _STUDY_OF_HITS + f", sr as (select {_K}, segment_id, {_COMP} as sret from ev where cost = 'baseline' and delay = 1 group by cell, symbol, cost, delay, segment_id), su as (select cell, avg(sret) as msr, exp(sum(ln(1 + sret))) - 1 as comp from sr group by 1){_CONTROL} select cell, 1::bigint as symbols, {_OK} and coalesce(difference > 0, false) as pass, round(difference, 6) as difference from su left join cd using (cell)")
def q_j13_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transfer of the lead and lag signal: gains at baseline cost and delay 1, and a mean above that of all bars."""
    pair = written(_pair(spark, sf_dir), "pairs")
    hits = written(signals.evaluate_grid(pair, "hyp0006"), "hits")
    ev = G.run_events(hits, pair, G.stress_grid(spark)).filter("cost = 'baseline' and delay = 1")
    return robustness.transferability(metrics.cell_summary(ev, ["cell", "symbol"]), ["cell"], G.control_by_cell(pair, hits))


@Q.add("q_J14", _J + " select cell, cost, delay, bool_and(comp >= 0.1 and msr > 0) as economic, sum(events)::bigint as trades, sum(nseg)::bigint as segments, sum(events) >= 300 and sum(nseg) >= 20 as support, bool_and(comp >= 0.1 and msr > 0) and sum(events) >= 300 and sum(nseg) >= 20 as pass from su group by 1, 2, 3")
def q_j14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return robustness.protocol_eligibility(summary(spark, sf_dir)[2], ["cell", "cost", "delay"])


#: Events of hits with a column ``hold``: how many bars each takes.
_STUDY_OF_HELD = _STUDY_OF_HITS.replace("h.bar_idx, d.delay from", "h.bar_idx, h.hold, d.delay from").replace("h.bar_idx + d.delay <= lb", "h.bar_idx + d.delay + h.hold - 1 <= lb")
_STUDY_OF_HELD = _STUDY_OF_HELD.replace("delay, min(bar_idx) as bar_idx from cand group by 1, 2, 3, 4", "delay, hold, min(bar_idx) as bar_idx from cand group by 1, 2, 3, 4, 5").replace("delay, nxt from", "delay, hold, nxt from").replace("c.bar_idx > w.bar_idx + w.delay)", "c.bar_idx >= w.bar_idx + w.delay + w.hold)")
_STUDY_OF_HELD = _STUDY_OF_HELD.replace("b.ts as exit_ts, b.close *", "x.ts as exit_ts, x.close *").replace("join stress s on", "join seg x on x.symbol = w.symbol and x.segment_id = w.segment_id and x.bar_idx = w.bar_idx + w.delay + w.hold - 1 join stress s on")


def _battery_sql(nine: bool, hits: str = _SHOCK_HITS, family: str = "0", held: bool = False, control: bool = False) -> str:
    """All dimensions by cell, each a table (cell, symbol, ok), over the pieces of the queries above; ``family`` says which cells are
    neighbours, ``held`` that hits have a column hold, ``control`` that transfer is held against all bars of ``pr``."""
    base = "cost = 'baseline' and delay = 1"
    regime = "count(*) filter (events >= 100 and comp > 0) >= 2" if nine else "count(*) filter (bars >= 100) < 2 or count(*) filter (bars >= 100 and comp > 0) >= 2"
    fall = "n > 0 and mdd < 0.7 and least(worst, 0) >= -0.5 and " + ("exit_recovery <= 0.5 * bars" if nine else "recovery <= 0.5 * duration")
    dims = {
        "fee_slippage": f"select cell, symbol, {_OK} as ok from su where cost = 'stress_2' and delay = 1",
        "timing": f"select cell, symbol, {_OK} as ok from su where cost = 'baseline' and delay = 2",
        "regime_stability": f"select cell, symbol, {regime} as ok from rc where {base} group by 1, 2",
        "sample_size_stability": f"select tt.cell, tt.symbol, avg((exp(rest) - 1 > 1e-12)::int) >= 0.75 and any_value(su.comp) > 0 as ok from tt join su using ({_K}) where {base} group by 1, 2",
        "concentration": f"select cell, symbol, max_share <= 0.5 and top <= 0.5 as ok from (select {_K}, max(ln(1 + sret)) filter (sret > 0) / nullif(sum(ln(1 + sret)) filter (sret > 0), 0) as max_share from sr group by 1, 2, 3, 4) left join (select {_K}, sum(ret) filter (k <= greatest(1, ceil(n * 0.1))) / sum(ret) as top from (select *, row_number() over (partition by {_K} order by ret desc) as k, count(*) over (partition by {_K}) as n from ev where ret > 0) group by 1, 2, 3, 4) using ({_K}) where {base}",
        "drawdown_recovery": f"select cell, symbol, {fall} as ok from dd join ws using ({_K}) join rk using ({_K}) join du using (symbol) where {base}",
        "asset_transferability": f"select cell, symbol, {_OK} as ok from su where {base}",
    }
    if control:
        dims["asset_transferability"] = f"select cell, symbol, {_OK} and coalesce(difference > 0, false) as ok from su left join cd using (cell) where {base}"
    if nine:
        dims["protocol_eligibility"] = f"select s.cell, s.symbol, s.comp >= 0.1 and s.msr > 0 and d.ok and t.support as ok from (select * from su where {base}) s join d_drawdown_recovery d using (cell, symbol) join (select cell, sum(events) >= 300 and sum(nseg) >= 20 as support from su where {base} group by 1) t on t.cell = s.cell"
    names = ["parameter_neighborhood", *dims]
    rest = _REG[len(_STUDY):] + _LOO[len(_SEGS):] + _DD[len(_SEGS):] + (_RECOVERY.replace("entry_ts", "exit_ts") if held else _RECOVERY) + (_CONTROL if control else "")
    study = _J[len(_SHOCK_HITS):].replace(_STUDY_OF_HITS, _STUDY_OF_HELD) if held else _J[len(_SHOCK_HITS):]
    tables = "".join(f", d_{n} as ({q})" for n, q in dims.items())
    around = f", d_parameter_neighborhood as (select c.cell, symbol, ok from (select *, {family} as fam from cells) c join (select {family} as fam, symbol, avg((msr > 0)::int) >= 0.6 and quantile_cont(comp, 0.5) > 0 as ok from su where {base} group by 1, 2) using (fam))"
    every = ", fr as (select c.cell, y.symbol from cells c cross join (select distinct symbol from seg) y)"
    joined = "".join(f" left join (select cell, symbol, ok as {n} from d_{n}) using (cell, symbol)" for n in names)
    wide = f", wd as (select cell, {', '.join(f'bool_and(coalesce({n}, false)) as {n}' for n in names)} from fr{joined} group by 1)"
    failed = "array_to_string(list_filter([" + ", ".join(f"case when not {n} then '{n}' end" for n in names) + "], lambda x: x is not null), ',')"
    passed = " + ".join(f"{n}::int" for n in names)
    return hits + study + rest + tables + around + every + wide + f" select cell, {failed} as failed, {len(names)} as required, {passed} as passed, case when {passed} = {len(names)} then 'PASS' else 'FAIL' end as decision from wd"


def _decision(name: str, nine: bool) -> None:
    @Q.add(name, _battery_sql(nine))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        seg, ev = study(spark, sf_dir)
        dims = robustness.battery(ev, seg, signals.param_grid(spark, SHOCK), nine)
        return robustness.decide(dims, ["cell"]).withColumn("failed", F.array_join("failed", ","))


_decision("q_J15", False)
_decision("q_J15_nine", True)

_ONE_BAR = tuple(n for n in signals.BASES if n != "hyp0006" and not signals.SIGNALS[n].hold)
_BASES_OF = {n: research.SPAN * k + signals.base_cell(n) for k, n in enumerate(_ONE_BAR)}


def _all_hits(pre: str) -> str:
    """Hits of all cells of all hypotheses on single bars, on ``seg`` of ``pre``; ``cells`` are the bases."""
    return f"{pre}{_FEAT}{_GRIDS}, cells(cell) as (values {', '.join(f'({c})' for c in _BASES_OF.values())}), hits as (" + " union all ".join(f"select {research.SPAN * k} + cell as cell, symbol, segment_id, bar_idx from f2 join g_{n} as cells on bar_idx >= 1 and {_RULES[n]}" for k, n in enumerate(_ONE_BAR)) + ")"


@Q.add("q_J15_cycles", "select case cell " + " ".join(f"when {c} then '{n}'" for n, c in _BASES_OF.items()) + " end as hypothesis, failed, required, passed, decision from (" + _battery_sql(False, _all_hits(_PRE), "cell // 1000") + ")")
def q_j15_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From raw rows to the decision of every hypothesis of the next to the sixth cycle on single bars: segments, all cells of all grids, events under all costs and delays, the battery at each base."""
    out = research.decide_hypotheses(written(daily(spark, sf_dir), "bars"), _ONE_BAR)
    return out.withColumn("failed", F.array_join("failed", ","))


@Q.add("q_J16_segments", _SEGS + ", sz as (select symbol, segment_id, count(*) as bars from seg group by 1, 2), r1 as (select cell, symbol, segment_id, events, sret from sr where cost = 'baseline' and delay = 1) select c.cell, z.symbol, z.segment_id, z.bars, coalesce(r.events, 0) as events, round(r.sret, 6) as segment_return, case when z.bars < 100 then 'segment of ' || z.bars || ' bars, 100 needed' when r.sret <= -1 then 'segment lost everything' when r.events is null then 'no events' end as error from sz z cross join cells c left join r1 r on r.cell = c.cell and r.symbol = z.symbol and r.segment_id = z.segment_id")
def q_j16_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg, ev = study(spark, sf_dir)
    return robustness.segment_rows(seg, ev.filter("cost = 'baseline' and delay = 1"), signals.param_grid(spark, SHOCK).select("cell"), ["cell", "symbol"], 100)


@Q.add("q_J16", _hits_sql("hyp0005") + ", sy as (select distinct symbol from seg) select c.cell, y.symbol, count(h.bar_idx) > 0 as has_hits from cells c cross join sy y left join hits h on h.cell = c.cell and h.symbol = y.symbol group by 1, 2")
def q_j16(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = daily(spark, sf_dir)
    hits = signals.evaluate_grid(seg, "hyp0005").groupBy("cell", "symbol").agg(F.lit(0.0).alias("compound_return"))
    cells = signals.param_grid(spark, signals.SIGNALS["hyp0005"].grid).select("cell").crossJoin(seg.select("symbol").distinct())
    return robustness.with_errors(cells, hits, ["cell", "symbol"]).select("cell", "symbol", F.col("error").isNull().alias("has_hits"))


# Allocation and classifier


@Q.add("q_K1", MONTHS + ", r as (select *, row_number() over (partition by symbol order by month desc) as k from closes) select symbol, case when arg_max(close, month) > avg(close) then round(1.0 / 3, 6)::double else 0.0 end as weight, null::varchar as error from r where k <= 10 group by 1")
def q_k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    closes = allocation.monthly_closes(X.daily_bars(spark, sf_dir))
    return allocation.target_weights(closes, closes)


_REB = "w as (select c_mktsegment as symbol, count(*) / sum(count(*)) over () as weight from customer where c_mktsegment <> 'BUILDING' group by 1), h as (select c_mktsegment as symbol, sum(c_acctbal) as value from customer where c_mktsegment <> 'MACHINERY' group by 1), j as (select symbol, 1000000 * coalesce(weight, 0) - coalesce(value, 0) as d from w full join h using (symbol))"


@Q.add("q_K2_K4", f"with {_REB} select symbol, case when d > 0 then 'buy' else 'sell' end as side, round(abs(d), 2) as notional, row_number() over (order by case when d > 0 then 'buy' else 'sell' end desc, symbol)::int as seq, (select count(*) > 0 from orders where o_orderstatus = 'P') as blocked from j where abs(d) >= 1")
def q_k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumnRenamed("c_mktsegment", "symbol")
    n = c.filter("symbol <> 'BUILDING'")
    weights = n.groupBy("symbol").agg(F.count("*").alias("k")).crossJoin(n.agg(F.count("*").alias("n"))).select("symbol", (F.col("k") / F.col("n")).alias("weight"))
    holdings = c.filter("symbol <> 'MACHINERY'").groupBy("symbol").agg(F.sum("c_acctbal").alias("value"))
    plan = allocation.rebalance(weights, holdings, 1_000_000.0)
    return allocation.guard_pending(plan, spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderstatus = 'P'"))


@Q.add("q_K3", MONTHS + """, m as (select *, row_number() over w as i, avg(close) over (partition by symbol order by month rows 9 preceding) as mean, lead(close) over w / close - 1 as nxt from closes window w as (partition by symbol order by month)), g as (select *, case when close > mean then 1.0::double / 3 else 0 end as w from m where i >= 10),
  t as (select *, abs(w - coalesce(lag(w) over (partition by symbol order by month), 0)) as turn from g), p as (select month, sum(w * nxt) - 0.001 * sum(turn) as r, max(nxt) filter (symbol = 'N') as b from t where nxt is not null group by 1), e as (select *, exp(sum(ln(1 + r)) over (order by month)) as e, exp(sum(ln(1 + b)) over (order by month)) as be from p), d as (select *, e / greatest(1.0, max(e) over (order by month)) - 1 as dd from e)
  select count(*) as months, round(arg_max(e, month) - 1, 6) as strategy_total_return, round(arg_max(be, month) - 1, 6) as benchmark_total_return, round(least(0.0, min(dd)), 6) as strategy_max_drawdown from d""")
def q_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allocation.monthly_backtest(allocation.monthly_closes(X.daily_bars(spark, sf_dir)), "N")


def _model_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bracket trades on daily bars by symbol with the classifier's features."""
    df = I.rsi(I.atr(segments.continuous_segments(X.daily_bars(spark, sf_dir), "1 day")))
    df = scans.over_blocks(df, lambda d: d.withColumn("vol_ratio", I.volume_to_mean(20)), 20)
    wicks = C.wick_features(F.col("open"), F.col("high"), F.col("low"), F.col("close"))
    df = df.withColumns({k: wicks[k] for k in ("upper_wick_to_body", "lower_wick_to_body")})
    df = I.rolling_mean(df, "volume", 20, "vol_ma")
    loud = F.col("volume") > F.col("vol_ma")
    short, long = F.col("close") < F.col("open"), F.col("close") > F.col("open")
    df = df.withColumns({"short": F.coalesce(short & loud, F.lit(False)), "long": F.coalesce(long & loud, F.lit(False))})
    return G.first_touch(df, fee=0.08, warm=F.col("atr").isNotNull() & F.col("rsi").isNotNull())


_ML = f"""{X.DAILY_SEG}, lv as (select *, row_number() over (partition by symbol order by ts) - 1 as i, count(*) over (partition by symbol) as cnt, case when count(volume) over v20 = 20 then avg(volume) over v20 end as vm, max(case when bar_idx >= 1 and close <> pc then 1 else 0 end) {_P}) as moved from (select *, lag(close) {_P}) as pc from seg) window v20 as (partition by symbol order by ts rows 19 preceding)),
  n as (select *, coalesce(close < open and volume > vm, false) as short, coalesce(close > open and volume > vm, false) as long from lv), t as (select *, case when short then high - close else close - low end as risk from n where (short or long) and i < cnt - 20 and bar_idx >= 14 and moved = 1),
  o as (select t.symbol, t.ts, t.short, min(case when (t.short and f.high >= t.high) or (not t.short and f.low <= t.low) then f.i * 2 when (t.short and f.low <= t.close - 2 * t.risk) or (not t.short and f.high >= t.close + 2 * t.risk) then f.i * 2 + 1 end) as hit from t join n f on f.symbol = t.symbol and f.i > t.i and f.i < t.i + 20 where t.risk > 0 group by 1, 2, 3),
  trades as (select symbol, ts, case when short then 'SHORT' else 'LONG' end as side, case when hit % 2 = 0 then -1.0 else 2.0 end - 0.08 as result, row_number() over (order by ts, symbol) as k, count(*) over () as n from o where hit is not null)"""


@Q.add("q_L1", _ML + " select symbol, ts, side, result::double as result, case when n >= 10 then case when k <= floor(n * 0.7) then 'train' else 'test' end end as part from trades")
def q_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.chrono_split(_model_trades(spark, sf_dir)).select("symbol", "ts", "side", "result", "part")


@Q.add("q_L2_L3")
def q_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = written(classifier.chrono_split(_model_trades(spark, sf_dir)), "trades")
    model = classifier.fit_win_filter(trades.filter("part = 'train'"))
    return classifier.filter_report(model.transform(trades.filter("part = 'test'")))

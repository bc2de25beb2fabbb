"""Queries of bar shapes, segments and indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import allocation, scans, segments
from ..operators import indicators as I
from . import fixtures as X
from .registering import Registry

Q = Registry()

_P = "over (partition by symbol, segment_id order by bar_idx"
_ID = "symbol, segment_id, bar_idx"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.continuous_segments(X.daily_bars(spark, sf_dir), "1 day")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.continuous_segments(X.event_bars(spark, sf_dir), "1 hour")


def _ids(df: DataFrame, **columns: Column | str) -> DataFrame:
    return df.select("symbol", "segment_id", "bar_idx", *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def _sql(expressions: dict[str, str], source: str = "seg", prelude: str = X.DAILY_SEG, more: str = "") -> str:
    return f"{prelude}{more} select {_ID}, " + ", ".join(f"round({e}, 6) as {n}" for n, e in expressions.items()) + f" from {source}"


def _w(a: str, b: str) -> str:
    return f"{_P} rows between {a} and {b})"


def _prior(n: int) -> str:
    return _w(f"{n} preceding", "1 preceding")


def _last(n: int) -> str:
    return _w(f"{n - 1} preceding", "current row")


def _when(n: int, e: str) -> str:
    return f"case when bar_idx >= {n} then {e} end"


_RET = f"close / lag(close) {_P}) - 1"
_BASE = f", base as (select *, {_RET} as ret_1, abs({_RET}) as abs_ret, (high - low) / lag(close) {_P}) as range_prev from seg)"


def _indicator(name: str, expressions: dict[str, str], build, source: str = "seg", more: str = "", hours: bool = False, blocks: bool = True) -> None:  # noqa: ANN001
    """Registers ``build`` of daily or hourly bars, by blocks of segments unless it sees to them itself."""

    @Q.add(name, _sql(expressions, source, X.HOURLY_SEG if hours else X.DAILY_SEG, more))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        seg = (hourly if hours else daily)(spark, sf_dir)
        return scans.over_blocks(seg, build) if blocks else build(seg)


_LOC = "case when high > low then (close - low) / (high - low) else 0 end"
_indicator("q_B13", {"location": _LOC}, lambda s: _ids(s, location=C.close_location(F.col("high"), F.col("low"), F.col("close"))))
_indicator(
    "q_B14",
    {"body": "abs(close - open)", "upper_wick": "high - greatest(open, close)", "lower_wick": "least(open, close) - low", "upper_wick_to_body": "(high - greatest(open, close)) / (abs(close - open) + 1e-8)", "lower_wick_to_body": "(least(open, close) - low) / (abs(close - open) + 1e-8)"},
    lambda s: _ids(s, **C.wick_features(F.col("open"), F.col("high"), F.col("low"), F.col("close"))),
    hours=True,
)
_indicator(
    "q_B15",
    {"body_range": "case when high > low then (close - open) / (high - low) end", "range_prev": f"(high - low) / lag(close) {_P})", "body_prev": f"(close - open) / lag(close) {_P})"},
    lambda s: _ids(s, body_range=F.when(F.col("high") > F.col("low"), (F.col("close") - F.col("open")) / (F.col("high") - F.col("low"))), range_prev=(F.col("high") - F.col("low")) / I.lag("close", 1), body_prev=(F.col("close") - F.col("open")) / I.lag("close", 1)),
)


@Q.add("q_D11", f"{X.GAP_SEG} select symbol, ts, bar_idx >= 4 and ts - interval 4 day >= timestamp '1996-06-01' as eligible from seg")
def q_d11(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = segments.continuous_segments(X.gap_bars(spark, sf_dir), "1 day")
    return segments.lookback_eligible(seg, 5, "1996-06-01", "1 day").select("symbol", "ts", "eligible")


@Q.add("q_D12", f"{X.GAP_SEG} select symbol, ts, bar_idx > 0 as eligible from seg")
def q_d12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.return_eligible(segments.continuous_segments(X.gap_bars(spark, sf_dir), "1 day")).select("symbol", "ts", "eligible")


_indicator("q_E1", {f"r{k}": f"close / lag(close, {k}) {_P}) - 1" for k in (1, 3, 4, 24, 168)}, lambda s: _ids(s, **{f"r{k}": I.ret(k) for k in (1, 3, 4, 24, 168)}))
_indicator("q_E2", {"deviation": _when(23, f"close / avg(close) {_last(24)} - 1")}, lambda s: _ids(s, deviation=F.col("close") / I.sma(24) - 1))
_EMA = """, recursive_ema as (with recursive e as (select symbol, segment_id, bar_idx, close as v from seg where bar_idx = 0 union all select s.symbol, s.segment_id, s.bar_idx, s.close * (2.0::double / 25) + e.v * (1 - 2.0::double / 25) from e join seg s on s.symbol = e.symbol and s.segment_id = e.segment_id and s.bar_idx = e.bar_idx + 1) select * from e)"""
_indicator("q_E3", {"ema": "v"}, lambda s: _ids(I.ema(s, 24, out="ema"), ema="ema"), "recursive_ema", _EMA, blocks=False)
_indicator("q_E4", {"high_close": _when(24, f"max(close) {_prior(24)}"), "low_close": _when(24, f"min(close) {_prior(24)}"), "high_high": _when(24, f"max(high) {_prior(24)}")}, lambda s: _ids(s, high_close=I.prior_extreme("close", 24), low_close=I.prior_extreme("close", 24, False), high_high=I.prior_extreme("high", 24)))
_indicator("q_E5", {"norm_range": _when(23, f"(max(high) {_last(24)} - min(low) {_last(24)}) / avg(close) {_last(24)}")}, lambda s: _ids(s, norm_range=I.norm_range(24)))
_indicator("q_E6", {"range_ratio": _when(23, f"(max(high) {_last(24)} - min(low) {_last(24)}) / close")}, lambda s: _ids(s, range_ratio=I.range_ratio(24)))
_indicator("q_E7", {"median_volume": _when(24, f"quantile_cont(volume, 0.5) {_prior(24)}")}, lambda s: _ids(s, median_volume=I.prior_median("volume", 24)))
_indicator("q_E8", {"median_abs": _when(25, f"quantile_cont(abs_ret, 0.5) {_prior(24)}")}, lambda s: _ids(I.with_base_columns(s), median_abs=I.prior_abs_ret_median(24)), "base", _BASE)
_indicator("q_E9", {"realized": _when(13, f"avg(abs_ret) {_prior(12)}")}, lambda s: _ids(I.with_base_columns(s), realized=I.prior_realized_vol(12)), "base", _BASE)
_VOL = _BASE + f", vol as (select *, {_when(13, f'avg(abs_ret) {_prior(12)}')} as vol_12 from base)"
_indicator("q_E10", {"median_vol": _when(61, f"quantile_cont(vol_12, 0.5) {_prior(48)}")}, lambda s: _ids(I.with_base_columns(s).withColumn("vol_12", I.prior_realized_vol(12)), median_vol=I.median_of_vol()), "vol", _VOL)
_indicator("q_E11", {"expansion": _when(24, f"range_prev / nullif(quantile_cont(range_prev, 0.5) {_prior(24)}, 0)")}, lambda s: _ids(I.with_base_columns(s), expansion=I.range_expansion(24)), "base", _BASE)
_indicator("q_E12", {"ratio": _when(24, f"volume / nullif(quantile_cont(volume, 0.5) {_prior(24)}, 0)"), "to_mean": _when(19, f"volume / (avg(volume) {_last(20)} + 1e-8)")}, lambda s: _ids(s, ratio=I.volume_ratio(24), to_mean=I.volume_to_mean(20)))
_RANK = f", rr as (select *, {_when(23, f'(max(high) {_last(24)} - min(low) {_last(24)}) / close')} as range_24 from seg), lr as (select *, lag(range_24) {_P}) as latest, list(range_24) {_w('721 preceding', '2 preceding')} as refs from rr)"
_indicator("q_E13", {"rank": _when(744, "len(list_filter(refs, lambda x: x <= latest)) / 720.0::double")}, lambda s: _ids(I.prior_rank(s, "rank"), rank="rank"), "lr", _RANK, blocks=False)
_DAY = "over (partition by symbol, ts::date order by ts rows unbounded preceding)"
_VWAP = f", vw as (select *, (high + low + close) / 3 as typ, sum((high + low + close) / 3 * volume) {_DAY} / sum(volume) {_DAY} as vwap from seg), vs as (select *, sqrt(sum(power(typ - vwap, 2) * volume) {_DAY} / sum(volume) {_DAY}) as std from vw)"
_indicator("q_E14", {"vwap": "vwap"}, lambda s: _ids(I.vwap_bands(s), vwap="vwap"), "vs", _VWAP, True, False)
_indicator("q_E15", {"vwap_std": "std", "upper_band": "vwap + 2 * std", "lower_band": "vwap - 2 * std"}, lambda s: _ids(I.vwap_bands(s), vwap_std="vwap_std", upper_band="upper_band", lower_band="lower_band"), "vs", _VWAP, True, False)
_indicator("q_E16", {"vol_ma": "case when count(*) over (partition by symbol order by ts rows 19 preceding) = 20 then avg(volume) over (partition by symbol order by ts rows 19 preceding) end"}, lambda s: _ids(I.rolling_mean(s, "volume", 20, "vol_ma"), vol_ma="vol_ma"), hours=True, blocks=False)
_TR = f", pv as (select *, lag(close) {_P}) as pc from seg), tr as (select *, case when pc is not null then greatest(high - low, abs(high - pc), abs(low - pc)) end as tr from pv)"
_indicator("q_E17", {"true_range": "tr", "atr": _when(14, f"avg(tr) {_last(14)}")}, lambda s: _ids(I.atr(s), true_range="true_range", atr="atr"), "tr", _TR, True, False)
_RSI = f""", ch as (select symbol, segment_id, bar_idx, close - lag(close) {_P}) as d from seg), rsi as (with recursive e as (select symbol, segment_id, bar_idx, greatest(d, 0) as u, greatest(-d, 0) as v from ch where bar_idx = 1 union all
   select c.symbol, c.segment_id, c.bar_idx, greatest(c.d, 0) / 14 + e.u * 13 / 14, greatest(-c.d, 0) / 14 + e.v * 13 / 14 from e join ch c on c.symbol = e.symbol and c.segment_id = e.segment_id and c.bar_idx = e.bar_idx + 1) select ch.symbol, ch.segment_id, ch.bar_idx, e.u, e.v from ch left join e using (symbol, segment_id, bar_idx))"""
_indicator("q_E18", {"rsi": "case when v > 0 then 100 - 100 / (1 + u / v) when u > 0 then 100 end"}, lambda s: _ids(I.rsi(s), rsi="rsi"), "rsi", _RSI, True, False)


@Q.add("q_E19", f"{X.DAILY_SEG} select {_ID}, case when r > 0.1 then 'bull' when r < -0.1 then 'bear' when r is not null then 'neutral' end as regime from (select *, close / lag(close, 168) {_P}) - 1 as r from seg)")
def q_e19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.over_blocks(daily(spark, sf_dir), lambda s: _ids(s, regime=I.regime()))


@Q.add("q_E20", f"{X.DAILY_SEG}{_BASE} select {_ID}, case when bar_idx >= 4 then min(ret_1) {_prior(3)} > 0 end as rising, round({_when(4, f'lag(close) {_P}) / lag(close, 3) {_P}) - 1')}, 6) as move from base")
def q_e20(spark: SparkSession, sf_dir: str) -> DataFrame:
    rising, move = I.streak(3)
    return scans.over_blocks(daily(spark, sf_dir), lambda s: _ids(I.with_base_columns(s), rising=rising, move=move))


@Q.add("q_E21", f"with {X.HOURLY_SQL} select ts, hour(ts)::int as hour, (isodow(ts) - 1)::int as weekday from bars")
def q_e21(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour, weekday = I.calendar_cols(F.col("ts"))
    return X.event_bars(spark, sf_dir).select("ts", hour.alias("hour"), weekday.alias("weekday"))


_indicator("q_E22", {"gap": f"open / lag(close) {_P}) - 1"}, lambda s: _ids(s, gap=I.opening_gap()), hours=True)
MONTHS = f"with {X.DAILY_SQL}, closes as (select symbol, date_trunc('month', ts)::date as month, arg_max(close, ts) as close from bars group by 1, 2)"


@Q.add("q_E23", MONTHS + ", r as (select *, row_number() over (partition by symbol order by month desc) as k from closes) select symbol, count(*) as months, arg_max(close, month) > avg(close) as up, null::varchar as error from r where k <= 10 group by 1")
def q_e23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.trend_up(allocation.monthly_closes(X.daily_bars(spark, sf_dir)))

"""Causal indicators: window expressions on segmented bars.

Every function returns a Column that looks at the current and earlier bars of the segment only, null until
enough of them exist. Frames are written out with their count, since a frame shrinks at the segment's start. Put the columns on
long segments inside ``scans.over_blocks``. What looks back without bound (``ema``, ``rsi``) is a function of the DataFrame and
goes outside.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import scans
from .scans import over_blocks
from .segments import frame, ordered


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _full(value: Column, needed: int) -> Column:
    return F.when(F.col("bar_idx") >= needed, value)


def lag(c: str | Column, k: int) -> Column:
    return F.lag(c, k).over(ordered())


def ret(k: int = 1, c: str = "close") -> Column:
    """c / c[k bars ago] - 1."""
    return F.try_divide(F.col(c), lag(c, k)) - 1


def sma(n: int, c: str = "close") -> Column:
    """Mean of the last n, this one included."""
    return _full(F.avg(c).over(frame(-(n - 1), 0)), n - 1)


def prior_extreme(c: str, n: int, high: bool = True) -> Column:
    """Largest (or smallest) of the n before this bar."""
    return _full((F.max if high else F.min)(c).over(frame(-n, -1)), n)


def norm_range(n: int) -> Column:
    """(highest high - lowest low) / mean close of the last n."""
    w = frame(-(n - 1), 0)
    return _full((F.max("high").over(w) - F.min("low").over(w)) / F.avg("close").over(w), n - 1)


def range_ratio(n: int = 24) -> Column:
    """(highest high - lowest low) / close over the last n."""
    w = frame(-(n - 1), 0)
    return _full(F.when(F.col("close") > 0, (F.max("high").over(w) - F.min("low").over(w)) / F.col("close")), n - 1)


def prior_median(c: str, n: int, needed: int | None = None) -> Column:
    """Exact median of the n before this bar."""
    return _full(F.percentile(c, F.lit(0.5)).over(frame(-n, -1)), n if needed is None else needed)


def prior_mean(c: str, n: int, needed: int | None = None) -> Column:
    return _full(F.avg(c).over(frame(-n, -1)), n if needed is None else needed)


def with_base_columns(seg: DataFrame) -> DataFrame:
    """Adds what other indicators are taken over: one-bar return, its absolute value, range to the close before."""
    return seg.withColumns({"ret_1": ret(1), "abs_ret": F.abs(ret(1)), "range_prev": F.try_divide(F.col("high") - F.col("low"), lag("close", 1)), "location": F.when(F.col("high") > F.col("low"), (F.col("close") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.lit(0.0))})


def prior_abs_ret_median(n: int) -> Column:
    """Median absolute return of the n bars before (needs n + 1 of history). Over ``with_base_columns``."""
    return prior_median("abs_ret", n, n + 1)


def prior_realized_vol(n: int) -> Column:
    """Mean absolute return of the n bars before. Over ``with_base_columns``."""
    return prior_mean("abs_ret", n, n + 1)


def median_of_vol(c: str = "vol_12", m: int = 48, n: int = 12) -> Column:
    """Median of the m values of ``c`` (a realised volatility over n) before this bar, all present."""
    return _full(F.percentile(c, F.lit(0.5)).over(frame(-m, -1)), m + n + 1)


def range_expansion(n: int) -> Column:
    """Range to the close before, against its median over the n bars before. Over ``with_base_columns``."""
    m = F.percentile("range_prev", F.lit(0.5)).over(frame(-n, -1))
    return _full(F.when(m > 0, F.col("range_prev") / m), n)


def volume_ratio(n: int) -> Column:
    m = prior_median("volume", n)
    return F.when(m > 0, F.col("volume") / m)


def volume_to_mean(n: int = 20) -> Column:
    """Volume against its mean over the last n (plus 1e-8)."""
    return F.col("volume") / (sma(n, "volume") + 1e-8)


class _Ordered:
    """The last ``n`` values in order: a binary search adds one, another takes out the oldest. Nulls take a place but have no order."""

    def __init__(self, n: int) -> None:
        self.n, self.came, self.order = n, deque(), []

    def add(self, x: float | None) -> None:
        self.came.append(x)
        if x is not None:
            insort(self.order, x)
        if len(self.came) > self.n and (old := self.came.popleft()) is not None:
            del self.order[bisect_left(self.order, old)]

    def median(self) -> float | None:
        k = len(self.order)
        return (self.order[(k - 1) // 2] + self.order[k // 2]) / 2 if k else None

    def share(self, x: float | None) -> float | None:
        return bisect_right(self.order, x) / self.n if x is not None and len(self.order) == self.n else None


def moving_order(seg: DataFrame, values: dict[str, tuple[str, str, int]], halo: int = 1_000, block: int | None = None) -> DataFrame:
    """``seg`` with order statistics of moving windows: {name: (kind, column, n)}.

    'median': of the ``n`` values before this bar, nulls left out. 'rank': the share of ``n`` earlier values that are at most the
    latest one before this bar, which isn't among them; null unless all are there.

    Bars are read in order, block by block of their segment (``halo`` must cover the windows and what their columns look back at). A task
    holds its windows in order: a bar costs a binary search a window, not a sort.
    """
    stats = list(values.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, windows, last = None, [], []
        for batch in batches:
            out, columns = [[] for _ in stats], [batch.column(c).to_pylist() for _, (_, c, _) in stats]
            for k, place in enumerate(zip(batch.column("_key").to_pylist(), batch.column("bar_idx").to_pylist())):
                if now is None or place != (now[0], now[1] + 1):
                    windows, last = [_Ordered(n) for _, (_, _, n) in stats], [None] * len(stats)
                now = place
                for i, (_, (kind, _, _)) in enumerate(stats):
                    x, w = columns[i][k], windows[i]
                    if kind == "median":
                        out[i].append(w.median())
                        w.add(x)
                    else:
                        out[i].append(w.share(last[i]))
                        w.add(last[i])
                        last[i] = x
            names = [c for c in batch.schema.names if c != "_key"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *[pa.array(o, pa.float64()) for o in out]], names=[*names, *values])

    def build(d: DataFrame) -> DataFrame:
        schema = StructType([*d.schema.fields, *[StructField(name, DoubleType()) for name in values]])
        dealt = d.withColumn("_key", F.xxhash64("symbol", "segment_id")).repartition("_key").sortWithinPartitions("_key", "symbol", "segment_id", "bar_idx")
        return dealt.mapInArrow(run, schema)

    return over_blocks(seg, build, halo, block=block)


def prior_rank(seg: DataFrame, out: str = "rank_720", n: int = 720, window: int = 24) -> DataFrame:
    """``seg`` with the share of n earlier range ratios over ``window`` bars that are at most the latest one before this bar."""
    ranged = over_blocks(seg, lambda d: d.withColumn(f"range_{window}", range_ratio(window)), window)
    ranked = moving_order(ranged, {out: ("rank", f"range_{window}", n)}, n + 2)
    return ranked.withColumn(out, _full(F.col(out), n + window))


def regime(k: int = 168, up: float = 0.10, down: float = -0.10) -> Column:
    """'bull', 'bear' or 'neutral' by the return over k bars; null without it."""
    r = ret(k)
    return F.when(r > up, "bull").when(r < down, "bear").when(r.isNotNull(), "neutral")


def streak(k: int) -> tuple[Column, Column]:
    """(all k returns before this bar are positive, the move from the first to the last of those bars). Over ``with_base_columns``."""
    rising = _full(F.min("ret_1").over(frame(-k, -1)) > 0, k + 1)
    return rising, _full(F.try_divide(lag("close", 1), lag("close", k)) - 1, k + 1)


def opening_gap() -> Column:
    return F.try_divide(F.col("open"), lag("close", 1)) - 1


def calendar_cols(ts: Column) -> tuple[Column, Column]:
    """UTC hour, and day of the week from Monday = 0."""
    return F.hour(ts), F.weekday(ts)


def ewm(df: DataFrame, value: str, alpha: float, out: str, first: int = 0, block: int = 256) -> DataFrame:
    """``df`` with ``out``: an exponential mean by segment, seeded with the value at bar ``first``; null before it.

    A block scan: within blocks of rows the weights are scaled sums; a block starts from the means that the
    blocks before it end with, folded over as many of their tails as still weigh 1e-18. A row costs its block, not
    its segment.
    """
    keep = 1.0 - alpha
    if keep <= 0.0:
        return df.withColumn(out, F.when(F.col("bar_idx") >= first, F.col(value).cast("double")))
    reach = math.ceil(math.log(1e-18) / (block * math.log(keep)))
    idx = F.col("bar_idx") - first
    at, blk = F.pmod(idx, F.lit(block)), F.floor(idx / block)
    own = Window.partitionBy("symbol", "segment_id", "_blk").orderBy("bar_idx")
    x = F.when(idx == 0, F.col(value)).otherwise(alpha * F.col(value))
    df = df.withColumns({"_blk": blk, "_at": at})
    df = df.withColumn("_part", F.sum(F.when(idx >= 0, x * F.pow(F.lit(keep), -F.col("_at")))).over(own) * F.pow(F.lit(keep), F.col("_at")))
    tails = df.filter(f"bar_idx >= {first} and _at = {block - 1}").select("symbol", "segment_id", (F.col("_blk") + 1).alias("_blk"), F.col("_part").alias("_tail"))
    carry = F.aggregate(F.collect_list("_tail").over(frame(1 - reach, 0)), F.lit(0.0), lambda s, t: s * keep**block + t)
    tails = over_blocks(tails.withColumnRenamed("_blk", "bar_idx"), lambda d: d.withColumn("_carry", carry), reach)
    tails = tails.select("symbol", "segment_id", F.col("bar_idx").alias("_blk"), "_carry")
    df = df.join(tails, ["symbol", "segment_id", "_blk"], "left")
    mean = F.col("_part") + F.coalesce("_carry", F.lit(0.0)) * F.pow(F.lit(keep), F.col("_at") + 1)
    return df.withColumn(out, F.when(idx >= 0, mean)).drop("_blk", "_at", "_part", "_carry")


def ema(df: DataFrame, n: int, value: str = "close", out: str | None = None) -> DataFrame:
    """``df`` with the exponential mean of ``n`` bars (alpha 2 / (n + 1)), seeded with the segment's first value."""
    return ewm(df, value, 2.0 / (n + 1), out or f"ema_{n}")


def rsi(df: DataFrame, n: int = 14) -> DataFrame:
    """``df`` with ``rsi``: exponential means (alpha 1 / n) of gains and losses, seeded at the first change; 100 without losses."""
    change = F.col("close") - lag("close", 1)
    df = over_blocks(df, lambda d: d.withColumn("_change", change), 1)
    change = F.col("_change")
    df = df.withColumns({"_gain": F.greatest(change, F.lit(0.0)), "_loss": F.greatest(-change, F.lit(0.0))})
    df = ewm(ewm(df, "_gain", 1.0 / n, "_up", 1), "_loss", 1.0 / n, "_down", 1)
    value = F.when(F.col("_down") > 0, 100 - 100 / (1 + F.col("_up") / F.col("_down"))).when(F.col("_up") > 0, F.lit(100.0))
    return df.withColumn("rsi", value).drop("_change", "_gain", "_loss", "_up", "_down")


def atr(df: DataFrame, n: int = 14) -> DataFrame:
    """``df`` with ``true_range`` (null on the first bar of a segment) and its mean ``atr`` over n bars."""
    prev = lag("close", 1)
    tr = F.when(prev.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))
    return over_blocks(df, lambda d: d.withColumn("true_range", tr).withColumn("atr", _full(F.avg("true_range").over(frame(-(n - 1), 0)), n)), n)


def vwap_bands(bars: DataFrame, k: float = 2.0) -> DataFrame:
    """``bars`` with the session's running ``vwap`` and ``vwap_std`` and bands ``k`` of it apart; a session is a UTC day."""
    day = Window.partitionBy("symbol", F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    df = bars.withColumn("_typical", typical)
    df = df.withColumn("vwap", F.try_divide(F.sum(F.col("_typical") * F.col("volume")).over(day), F.sum("volume").over(day)))
    spread = F.sum(F.pow(F.col("_typical") - F.col("vwap"), 2) * F.col("volume")).over(day)
    df = df.withColumn("vwap_std", F.sqrt(F.try_divide(spread, F.sum("volume").over(day))))
    return df.withColumns({"upper_band": F.col("vwap") + k * F.col("vwap_std"), "lower_band": F.col("vwap") - k * F.col("vwap_std")}).drop("_typical")


def positions(bars: DataFrame, step: str = "1 hour", block: int | None = None) -> DataFrame:
    """``bars`` as one series of each symbol, across days and gaps: segment_id 0 and their number as bar_idx, for windows by rows."""
    plain = bars.drop("segment_id", "bar_idx")
    return scans.number_runs(plain, ["symbol"], "ts", scans.time_block("ts", step, block), "true", [], "segment_id", "bar_idx")


def rolling_mean(bars: DataFrame, c: str, n: int, out: str, step: str = "1 hour") -> DataFrame:
    """``bars`` with the mean of the last n rows of the symbol, across days and gaps; null until there are n."""
    mean = F.when(F.count(c).over(frame(-(n - 1), 0)) == n, F.avg(c).over(frame(-(n - 1), 0)))
    own = {k: f"_{k}" for k in ("segment_id", "bar_idx") if k in bars.columns}
    every = positions(bars.withColumns({new: F.col(k) for k, new in own.items()}), step)
    every = over_blocks(every, lambda d: d.withColumn(out, mean), n).drop("segment_id", "bar_idx")
    return every.withColumnsRenamed({new: k for k, new in own.items()})


def trend_up(closes: DataFrame, n: int = 10) -> DataFrame:
    """Per symbol whether its last monthly close is above the mean of its last n: (symbol, ``months``, ``up``, ``error``)."""
    latest = Window.partitionBy("symbol").orderBy(F.col("month").desc())
    last = closes.withColumn("_r", F.row_number().over(latest)).filter(F.col("_r") <= n)
    out = last.groupBy("symbol").agg(F.count("*").alias("months"), F.max_by("close", "month").alias("last"), F.avg("close").alias("mean"), F.min(F.coalesce(F.col("close") > 0, F.lit(False))).alias("ok"))
    error = F.when(F.col("months") < n, "too few monthly closes").when(~F.col("ok"), "closes must be positive")
    return out.select("symbol", "months", F.when(error.isNull(), F.col("last") > F.col("mean")).alias("up"), error.alias("error"))

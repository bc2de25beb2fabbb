"""Column functions on bars: raw text to typed values, shape of a bar, costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_unit(text: Column) -> Column:
    """'milliseconds' from 1e11 and 'microseconds' from 1e14 (below 1e17); null for anything else."""
    n = text.try_cast("bigint")
    return F.when((n >= 10**11) & (n < 10**14), "milliseconds").when((n >= 10**14) & (n < 10**17), "microseconds")


def epoch_to_ts(text: Column) -> Column:
    """The exact UTC time of an epoch text in its unit; null where it has none. The session zone has to be UTC."""
    n, unit = text.try_cast("bigint"), epoch_unit(text)
    micros = F.when(unit == "milliseconds", n * 1000).when(unit == "microseconds", n)
    return F.timestamp_micros(micros).cast("timestamp_ntz")


def is_aligned(ts: Column, unit: str = "hour") -> Column:
    """Whether a time is on a boundary of ``unit``."""
    return ts == floor_interval(ts, unit)


def floor_interval(ts: Column, unit: str = "hour") -> Column:
    """The boundary of ``unit`` at or before a time."""
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def parse_decimal(text: Column) -> Column:
    """A finite decimal with 8 places, null for other text ('NaN' and 'Infinity' too)."""
    return F.trim(text).try_cast("decimal(20,8)")


def bar_violation(symbol: Column, ts: Column, o: Column, h: Column, lo: Column, c: Column, v: Column) -> Column:
    """The first rule of the bar contract that fails, in fixed order; null if none does. Nulls fail their rule."""
    no = lambda x: ~F.coalesce(x, F.lit(False))
    return (
        F.when(ts.isNull(), "timestamp missing")
        .when(no(F.trim(symbol) != ""), "symbol missing")
        .when(no((o > 0) & (h > 0) & (lo > 0) & (c > 0)), "price not above zero")
        .when(no((lo <= o) & (o <= h)), "open outside range")
        .when(no((lo <= c) & (c <= h)), "close outside range")
        .when(no(v >= 0), "volume below zero")
    )


def close_location(h: Column, lo: Column, c: Column) -> Column:
    """Where the close lies in the bar's range; 0 for an empty range."""
    return F.when(h > lo, (c - lo) / (h - lo)).otherwise(F.lit(0.0))


def wick_features(o: Column, h: Column, lo: Column, c: Column) -> dict[str, Column]:
    """Body, wicks, and wicks to body (plus 1e-8)."""
    body, up, down = F.abs(c - o), h - F.greatest(o, c), F.least(o, c) - lo
    return {"body": body, "upper_wick": up, "lower_wick": down, "upper_wick_to_body": up / (body + 1e-8), "lower_wick_to_body": down / (body + 1e-8)}


def net_return(entry: Column, exit_: Column, fee: Column, slip: Column) -> Column:
    """Return from buying at ``entry`` and selling at ``exit_``, both prices slipped against, a fee each way."""
    return (exit_ * (1 - slip)) / (entry * (1 + slip)) * (1 - fee) * (1 - fee) - 1

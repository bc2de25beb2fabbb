"""Bar tables built from the star-schema and event tables, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PRICES = ("open", "high", "low", "close", "volume")


def _exact(amount: str | Column) -> Column:
    """An amount as a decimal: its sums are the same in any order, those of doubles aren't."""
    return (F.col(amount) if isinstance(amount, str) else amount).cast("decimal(20,8)")


def _priced(df: DataFrame, symbol: str, ts: Column, price: str, status: str, volume: str) -> DataFrame:
    """Order-free bars: the two sides' means as open and close, quartiles for the range.

    Equal rows are counted first, by keys that need no objects; a bar takes each of them once, as often as it was found.
    """
    equal = df.groupBy(F.col(symbol).alias("symbol"), ts.cast("timestamp_ntz").alias("ts"), F.col(status).alias("side"), F.col(price).alias("price"), F.col(volume).alias("amount")).agg(F.count("*").alias("n"))
    times = F.col("n").cast("decimal(10,0)")
    priced = equal.withColumns({"paid": _exact("price") * times, "sold": _exact("amount") * times, "k": F.when(F.col("price").isNotNull(), F.col("n"))})

    def mean(side: str | None = None) -> Column:
        own = lambda c: F.col(c) if side is None else F.when(F.col("side") == side, F.col(c))
        return F.try_divide(F.sum(own("paid")).cast("decimal(28,8)"), F.sum(own("k")))

    out = priced.groupBy("symbol", "ts").agg(
        F.round(F.coalesce(mean("F"), mean()), 8).cast("double").alias("open"),
        F.round(F.coalesce(mean("O"), mean()), 8).cast("double").alias("close"),
        F.percentile("price", F.lit(0.75), F.col("n")).alias("q3"),
        F.percentile("price", F.lit(0.25), F.col("n")).alias("q1"),
        F.sum("sold").cast("double").alias("volume"),
    )
    out = out.withColumns({"high": F.greatest("open", "close", "q3"), "low": F.least("open", "close", "q1")})
    return out.select("symbol", "ts", *[F.round(c, 8).alias(c) for c in _PRICES])


def daily_bars(spark: SparkSession, sf_dir: str, unit: str = "day") -> DataFrame:
    """``lineitem`` by return flag and ``unit`` of the ship date."""
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return _priced(df, "l_returnflag", F.date_trunc(unit, "l_shipdate"), "l_extendedprice", "l_linestatus", "l_quantity")


def gap_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` by priority and day: sparse at small scale, so with many gaps."""
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return _priced(df, "o_orderpriority", F.date_trunc("day", "o_orderdate"), "o_totalprice", "o_orderstatus", "o_totalprice")


def event_bars(spark: SparkSession, sf_dir: str, by_type: bool = False) -> DataFrame:
    """``events`` by hour, all together or by type; first and last value by time."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("p", F.col("value") + 1)
    symbol = F.col("event_type") if by_type else F.lit("ALL")
    out = df.groupBy(symbol.alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(
        F.min_by("p", "ts").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "ts").alias("close"), F.sum(_exact("p")).cast("double").alias("volume")
    )
    return out.select("symbol", F.col("hour").alias("ts"), *[F.round(c, 8).alias(c) for c in _PRICES])


def _priced_sql(table: str, symbol: str, ts: str, price: str, status: str, volume: str) -> str:
    return f"""bars as (select symbol, ts, round(open, 8) as open, round(greatest(open, close, q3), 8) as high, round(least(open, close, q1), 8) as low, round(close, 8) as close, round(volume, 8) as volume
      from (select {symbol} as symbol, {ts} as ts, coalesce(avg({price}) filter (where {status} = 'F'), avg({price})) as open, coalesce(avg({price}) filter (where {status} = 'O'), avg({price})) as close,
        quantile_cont({price}, 0.75) as q3, quantile_cont({price}, 0.25) as q1, {volume} as volume from {table} group by 1, 2))"""


def _event_sql(symbol: str) -> str:
    return f"""bars as (select symbol, ts, round(open, 8) as open, round(high, 8) as high, round(low, 8) as low, round(close, 8) as close, round(volume, 8) as volume
      from (select {symbol} as symbol, date_trunc('hour', ts)::timestamp as ts, arg_min(value + 1, events.ts) as open, max(value + 1) as high, min(value + 1) as low, arg_max(value + 1, events.ts) as close, sum(value + 1) as volume
        from events group by {symbol}, date_trunc('hour', ts)))"""


def segments_sql(step: str) -> str:
    """``seg``: ``bars`` with segment and place in it."""
    return f"""stepped as (select *, case when ts = lag(ts) over (partition by symbol order by ts) + interval {step} then 0 else 1 end as fresh from bars),
      cut as (select *, sum(fresh) over (partition by symbol order by ts) - 1 as segment_id from stepped),
      seg as (select symbol, ts, open, high, low, close, volume, segment_id::bigint as segment_id, row_number() over (partition by symbol, segment_id order by ts) - 1 as bar_idx from cut)"""


DAILY_SQL = _priced_sql("lineitem", "l_returnflag", "date_trunc('day', l_shipdate)::timestamp", "l_extendedprice", "l_linestatus", "sum(l_quantity)")
WEEKLY_SQL = DAILY_SQL.replace("'day'", "'week'")
GAP_SQL = _priced_sql("orders", "o_orderpriority", "date_trunc('day', o_orderdate)::timestamp", "o_totalprice", "o_orderstatus", "sum(o_totalprice)")
HOURLY_SQL = _event_sql("'ALL'")
TYPE_SQL = _event_sql("event_type")
DAILY_SEG = f"with {DAILY_SQL}, {segments_sql('1 day')}"
GAP_SEG = f"with {GAP_SQL}, {segments_sql('1 day')}"
HOURLY_SEG = f"with {HOURLY_SQL}, {segments_sql('1 hour')}"
TYPE_SEG = f"with {TYPE_SQL}, {segments_sql('1 hour')}"

"""Long ordered series in blocks: runs, running values and windows without a task per symbol.

Rows are dealt by key and block. What a block needs of those before it is one row per block (the carry table), over which a
window by key runs; or a halo of rows that is dealt to the next blocks as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bars of one block, about. Results don't depend on it.
BLOCK = 50_000
_SECONDS = {"second": 1, "minute": 60, "hour": 3_600, "day": 86_400, "week": 604_800, "month": 2_592_000, "year": 31_536_000}


def time_block(ts: str, step: str, bars: int | None = None) -> Column:
    """A number that grows with ``ts``: whole days, as many as ``bars`` steps of ``step`` (such as '1 hour') take."""
    count, unit = step.split()
    days = max(1, round((bars or BLOCK) * int(count) * _SECONDS[unit.lower().rstrip("s")] / 86_400))
    return F.floor(F.datediff(F.col(ts), F.lit("1970-01-01").cast("date")) / days)


def _joined(df: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with its block's carry row; null keys are keys."""
    names = [*keys, "_block"]
    carry = carry.select(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(names)], *[c for c in carry.columns if c not in names])
    same = F.lit(True)
    for i, k in enumerate(names):
        same = same & F.col(k).eqNullSafe(F.col(f"_c{i}"))
    return df.join(carry, same).drop(*[f"_c{i}" for i in range(len(names))])


def number_runs(df: DataFrame, keys: list[str], order: str, block: Column, same: str, look: list[str], run: str, place: str) -> DataFrame:
    """``df`` with ``run``, the number of its run from 0 by ``keys`` in ``order``, and ``place``, its number from 0 in the run.

    A row goes on with the run of the row before where ``same`` holds: a condition on the columns in ``look`` and
    ``prev_<column>``, those of the row before. ``block`` must grow with ``order``.
    """
    df = df.withColumn("_block", block)
    own = Window.partitionBy(*keys, "_block").orderBy(order)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    cut = F.when(F.row_number().over(own) == 1, 0).when(F.coalesce(F.expr(same), F.lit(False)), 0).otherwise(1)
    df = df.withColumns({f"prev_{c}": F.lag(c).over(own) for c in look}).withColumn("_cut", cut).drop(*[f"prev_{c}" for c in look])
    df = df.withColumn("_at", F.row_number().over(own) - 1)
    ends = {f"_first_{c}": F.min_by(c, order) for c in look} | {f"_last_{c}": F.max_by(c, order) for c in look}
    carry = df.groupBy(*keys, "_block").agg(F.count("*").alias("_rows"), F.sum("_cut").alias("_cuts"), F.max(F.when(F.col("_cut") == 1, F.col("_at"))).alias("_cut_at"), *[e.alias(n) for n, e in ends.items()])
    by = Window.partitionBy(*keys).orderBy("_block")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    for c in look:
        carry = carry.withColumns({f"prev_{c}": F.lag(f"_last_{c}").over(by), c: F.col(f"_first_{c}")})
    carry = carry.withColumn("_new", F.when(F.lag("_rows").over(by).isNotNull() & F.coalesce(F.expr(same), F.lit(False)), 0).otherwise(1))
    carry = carry.withColumn("_rows_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    start = F.col("_rows_before") + F.coalesce("_cut_at", F.when(F.col("_new") == 1, 0))
    carry = carry.withColumns({"_runs_before": F.coalesce(F.sum(F.col("_cuts") + F.col("_new")).over(before), F.lit(0)) + F.col("_new") - 1, "_start": start})
    carry = carry.withColumn("_begun", F.when(F.col("_new") == 1, F.col("_rows_before")).otherwise(F.last("_start", ignorenulls=True).over(before)))
    df = df.withColumns({"_n": F.sum("_cut").over(upto), "_own": F.max(F.when(F.col("_cut") == 1, F.col("_at"))).over(upto)})
    df = _joined(df, carry.select(*keys, "_block", "_runs_before", "_rows_before", "_begun"), keys)
    begun = F.coalesce(F.col("_own") + F.col("_rows_before"), F.col("_begun"))
    df = df.withColumns({run: (F.col("_runs_before") + F.col("_n")).cast("bigint"), place: (F.col("_rows_before") + F.col("_at") - begun).cast("bigint")})
    return df.drop("_block", "_cut", "_at", "_n", "_own", "_runs_before", "_rows_before", "_begun")


_MERGE = {
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda a, b: F.coalesce(a, b)),
}


def running(df: DataFrame, keys: list[str], order: str, block: Column, values: dict[str, tuple[str, Column]]) -> DataFrame:
    """``df`` with running values from the first row of ``keys`` up to this one in ``order``: {name: (kind, column)}.

    Kinds: 'sum', 'max', and 'last', the last value that isn't null. ``block`` must grow with ``order``. Two levels: within
    blocks, and over one row per block. Without ``keys`` all rows are one series.
    """
    df = df.withColumns({"_block": block} | {f"_v{i}": c for i, (_, c) in enumerate(values.values())})
    own = Window.partitionBy(*keys, "_block").orderBy(order)
    aggregates = []
    for i, (kind, _) in enumerate(values.values()):
        value = F.col(f"_v{i}")
        whole = F.max_by(value, F.when(value.isNotNull(), F.col(order))) if kind == "last" else _MERGE[kind][0](value)
        aggregates.append(whole.alias(f"_b{i}"))
    carry = df.groupBy(*keys, "_block").agg(*aggregates)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select(*keys, "_block", *[_MERGE[kind][0](F.col(f"_b{i}")).over(before).alias(f"_c_{i}") for i, (kind, _) in enumerate(values.values())])
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"_w{i}": _MERGE[kind][0](F.col(f"_v{i}")).over(upto) for i, (kind, _) in enumerate(values.values())})
    df = _joined(df, carry, keys)
    out = df.withColumns({name: _MERGE[kind][1](F.col(f"_w{i}"), F.col(f"_c_{i}")) for i, (name, (kind, _)) in enumerate(values.items())})
    return out.drop("_block", *[f"{p}{i}" for p in ("_v", "_w", "_c_") for i in range(len(values))])


def over_blocks(seg: DataFrame, build: Callable[[DataFrame], DataFrame], halo: int = 1_000, ahead: int = 0, block: int | None = None) -> DataFrame:
    """``build(seg)``, where ``build`` adds windows by (symbol, segment_id) in order of bar_idx that look at most ``halo`` bars back and ``ahead`` bars on.

    A segment is cut in blocks of ``block`` bars, each with a halo of bars around it that its windows may see; so a
    segment is as many tasks as it has blocks. Within ``build``, ``segment_id`` is a pair of segment and block; its rows must keep
    symbol, segment_id and bar_idx. Windows over windows add up their lookbacks.
    """
    size = F.lit(block or BLOCK)
    first = F.greatest(F.lit(0), F.floor((F.col("bar_idx") - ahead) / size))
    blocks = F.sequence(first, F.floor((F.col("bar_idx") + halo) / size))
    cut = seg.withColumn("_to", F.explode(blocks)).withColumn("segment_id", F.struct(F.col("segment_id").alias("segment"), F.col("_to").alias("block"))).drop("_to")
    built = build(cut)
    return built.filter(F.floor(F.col("bar_idx") / size) == F.col("segment_id.block")).withColumn("segment_id", F.col("segment_id.segment"))

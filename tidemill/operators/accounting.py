"""Target-weight accounting on bars: delayed fills, costs, first-in-first-out results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written
from . import scans
from .segments import ordered

KEYS = ["cell", "symbol", "segment_id"]


def _ordered():  # noqa: ANN202
    return Window.partitionBy(*KEYS).orderBy("bar_idx")


def delayed_target(df: DataFrame, delay: int) -> DataFrame:
    """``df`` with ``wanted``: the target of ``delay`` bars ago (0 before), which fills at this bar's open.

    ``delay`` is 1 or 2. Targets outside 0 to 1 get an ``error``.
    """
    if delay not in (1, 2):
        raise ValueError("delay must be 1 or 2")
    bad = F.when(~F.coalesce(F.col("target").between(0, 1), F.lit(False)), "target must be between 0 and 1")
    return df.withColumn("wanted", F.coalesce(F.lag("target", delay).over(_ordered()), F.lit(0).cast(df.schema["target"].dataType))).withColumn("error", bad)


def binary_accounting(df: DataFrame, delay: int = 1, fee: float = 0.001, slip: float = 0.0005, capital: float = 1000.0) -> DataFrame:
    """Equity by bar of targets of 0 and 1: the rows of ``df`` with ``trade`` (number of the open or last one), ``position``, ``equity``, ``trade_pnl`` (on exit bars) and ``cost``.

    All windows, no fold: a trade multiplies equity by a closed form of its entry and exit opens, so equity before
    a trade is a running product of the trades that ended, and while held it follows the close. An open last
    trade is marked, not closed.
    """
    k = (1 - slip) * (1 - fee) / ((1 + slip) * (1 + fee))
    order = _ordered()
    df = delayed_target(df, delay).withColumn("_was", F.coalesce(F.lag("wanted").over(order), F.lit(0)))
    df = df.withColumns({"_in": (F.col("wanted") > F.col("_was")).cast("int"), "_out": (F.col("wanted") < F.col("_was")).cast("int")})
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"trade": F.sum("_in").over(upto), "_entry": F.last(F.when(F.col("_in") == 1, F.col("open")), ignorenulls=True).over(upto)})
    growth = F.when(F.col("_out") == 1, k * F.col("open") / F.col("_entry"))
    df = df.withColumn("_growth", growth)
    base = F.lit(capital) * F.exp(F.coalesce(F.sum(F.ln("_growth")).over(upto), F.lit(0.0)))
    df = df.withColumn("_flat", base)
    qty = F.col("_flat") / ((1 + fee) * (1 + slip) * F.col("_entry"))
    held = F.col("wanted") == 1
    df = df.withColumn("equity", F.when(held, qty * F.col("close")).otherwise(F.col("_flat")))
    before = F.col("_flat") / F.col("_growth")
    sold = before / ((1 + fee) * (1 + slip) * F.col("_entry")) * F.col("open") * (1 - slip)
    cost = F.when(F.col("_out") == 1, sold * fee).when(F.col("_in") == 1, F.col("_flat") - F.col("_flat") / (1 + fee)).otherwise(F.lit(0.0))
    return df.withColumns({"position": F.when(held, F.lit(1.0)).otherwise(F.lit(0.0)), "trade_pnl": F.col("_flat") - before, "cost": cost, "unrealized": F.when(held, F.col("equity") - F.col("_flat")).otherwise(F.lit(0.0))}).drop("_was", "_in", "_out", "_entry", "_growth", "_flat")


def _fold(fee: float, slip: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """At each open what is held moves to the share ``want`` of what everything is worth; a purchase pays its fee out of the money set aside for it.

        Rows come campaign by campaign in order, each from one unit of money; what is carried from row to row is cash and units.
        """
        now, cash, held = None, 1.0, 0.0
        for batch in batches:
            place = list(zip(*[batch.column(k).to_pylist() for k in (*KEYS, "campaign")]))
            taken, out = [], []
            for k, (o, want) in enumerate(zip(batch.column("open").to_pylist(), batch.column("wanted").to_pylist())):
                if place[k] != now:
                    now, cash, held = place[k], 1.0, 0.0
                worth = cash + held * o
                move = want * worth - held * o
                side = 0 if abs(move) <= 1e-12 * worth or (move < 0 and held <= 0) else 1 if move > 0 else -1
                price = o * (1 + side * slip)
                qty = move / (1 + fee) / price if side > 0 else held if want == 0 else min(held, -move / price)
                qty = qty if side else 0.0
                cash -= side * qty * price + qty * price * fee
                held = held + side * qty if want or side >= 0 else 0.0
                if side or want == 0:
                    taken.append(k)
                    out.append(({1: "buy", -1: "sell", 0: None}[side], qty, price, qty * price * fee, cash if want == 0 else None))
            columns = list(zip(*out)) if out else [()] * 5
            types = [pa.string(), *[pa.float64()] * 4]
            own = batch.select([*KEYS, "campaign", "bar_idx"]).take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, *[pa.array(c, t) for c, t in zip(columns, types)]], names=[*own.schema.names, "side", "qty", "price", "fee", "growth"])

    return run


def fractional_fills(df: DataFrame, delay: int = 1, fee: float = 0.001, slip: float = 0.0005, capital: float = 1000.0, block: int | None = None) -> DataFrame:
    """Fills of targets between 0 and 1: (keys, bar_idx, side, qty, price, fee).

    What is bought or sold depends on cash and units so far, but after a target of 0 all is cash, and all amounts scale with
    it. So a segment is cut after each target of 0 into campaigns, which are folded apart from one unit of money, row after row;
    a campaign's amounts are then multiplied by what the ones before it made of the capital. A task holds a campaign's
    cash and units only, however long it is. Null opens and targets count as bars without a fill.
    """
    size = block or scans.BLOCK
    wanted = scans.over_blocks(df.select(*KEYS, "bar_idx", "open", "target").withColumn("segment_id", F.struct("cell", "segment_id")), lambda d: d.withColumn("wanted", F.lag("target", delay).over(ordered())), delay, block=size)
    wanted = wanted.select(*KEYS[:2], F.col("segment_id.segment_id").alias("segment_id"), "bar_idx", F.col("open").cast("double"), F.coalesce("wanted", F.lit(0)).cast("double").alias("wanted")).filter("open is not null")
    out_of = F.when(F.col("wanted") == 0, 1).otherwise(0)
    cut = scans.running(wanted, KEYS, "bar_idx", F.floor(F.col("bar_idx") / size), {"_outs": ("sum", out_of)})
    cut = cut.withColumn("campaign", (F.col("_outs") - out_of).cast("bigint")).drop("_outs")
    dealt = cut.withColumn("_walk", F.xxhash64(*KEYS, "campaign")).repartition("_walk").sortWithinPartitions("_walk", *KEYS, "campaign", "bar_idx").drop("_walk")
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in KEYS)
    walked = written(dealt.mapInArrow(_fold(fee, slip), f"{kinds}, campaign bigint, bar_idx bigint, side string, qty double, price double, fee double, growth double"), "campaigns")
    ends = walked.filter("growth is not null").select(*KEYS, "campaign", "growth")
    before = scans.running(ends, KEYS, "campaign", F.floor(F.col("campaign") / size), {"_upto": ("sum", F.ln("growth"))})
    scale = before.select(*KEYS, (F.col("campaign") + 1).alias("campaign"), F.exp("_upto").alias("_scale"))
    fills = walked.filter("side is not null").drop("growth").join(scale, [*KEYS, "campaign"], "left")
    money = F.lit(capital) * F.coalesce("_scale", F.lit(1.0))
    return fills.select(*KEYS, "bar_idx", "side", (F.col("qty") * money).alias("qty"), "price", (F.col("fee") * money).alias("fee"))


def fifo_match(fills: DataFrame) -> DataFrame:
    """Sold lots in order of purchase: (keys, buy_idx, sell_idx, qty, cost, proceeds, pnl).

    Buys and sells are intervals of cumulated quantity. Their ends are put in one order; between two neighbouring ends
    the quantity was bought by the buy, and sold by the sell, whose end comes next. Fees are shared by quantity. No
    state is walked and no fill meets another by a join.
    """
    order = Window.partitionBy(*KEYS, "side").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    fill = F.struct(F.col("bar_idx").alias("idx"), "qty", "price", "fee")
    ends = fills.select(*KEYS, "side", F.sum("qty").over(order).alias("hi"), fill.alias("fill"))
    back = Window.partitionBy(*KEYS).orderBy(F.col("hi").desc(), "side")
    upto = back.rowsBetween(Window.unboundedPreceding, 0)
    of = lambda side: F.last(F.when(F.col("side") == side, F.col("fill")), ignorenulls=True).over(upto)
    out = ends.withColumns({"b": of("buy"), "s": of("sell"), "qty": F.col("hi") - F.coalesce(F.lead("hi").over(back), F.lit(0.0))})
    out = out.filter("b is not null and s is not null and qty > 1e-9 * least(b.qty, s.qty)")
    cost = F.col("qty") * F.col("b.price") + F.col("b.fee") * F.col("qty") / F.col("b.qty")
    proceeds = F.col("qty") * F.col("s.price") - F.col("s.fee") * F.col("qty") / F.col("s.qty")
    return out.select(*KEYS, F.col("b.idx").alias("buy_idx"), F.col("s.idx").alias("sell_idx"), "qty", cost.alias("cost"), proceeds.alias("proceeds"), (proceeds - cost).alias("pnl"))


def equity_curve(df: DataFrame, fills: DataFrame, capital: float = 1000.0) -> DataFrame:
    """Bars with ``units``, ``equity`` and ``position`` from fills."""
    signed = fills.select(*KEYS, "bar_idx", F.when(F.col("side") == "buy", F.col("qty")).otherwise(-F.col("qty")).alias("_du"), F.when(F.col("side") == "buy", -F.col("qty") * F.col("price") - F.col("fee")).otherwise(F.col("qty") * F.col("price") - F.col("fee")).alias("_dc"))
    out = df.join(signed, [*KEYS, "bar_idx"], "left")
    out = scans.running(out, KEYS, "bar_idx", F.floor(F.col("bar_idx") / scans.BLOCK), {"units": ("sum", F.col("_du")), "_cash": ("sum", F.col("_dc"))})
    out = out.withColumns({"units": F.coalesce("units", F.lit(0.0)), "_cash": F.lit(capital) + F.coalesce("_cash", F.lit(0.0))})
    out = out.withColumn("equity", F.col("_cash") + F.col("units") * F.col("close"))
    return out.withColumn("position", F.when(F.col("equity") > 0, F.col("units") * F.col("close") / F.col("equity")).otherwise(F.lit(0.0))).drop("_du", "_dc", "_cash")


def account_totals(curve: DataFrame, fills: DataFrame, lots: DataFrame) -> DataFrame:
    """Per keys: final equity, fees, realised and unrealised result."""
    last = curve.groupBy(*KEYS).agg(F.max_by("equity", "bar_idx").alias("final_equity"), F.max_by("units", "bar_idx").alias("units"), F.max_by("close", "bar_idx").alias("close"))
    fees = fills.groupBy(*KEYS).agg(F.sum("fee").alias("fees"), F.sum(F.when(F.col("side") == "buy", F.col("qty") * F.col("price") + F.col("fee"))).alias("bought"))
    sold = lots.groupBy(*KEYS).agg(F.sum("pnl").alias("realized"), F.sum("cost").alias("closed_cost"))
    df = last.join(fees, KEYS, "left").join(sold, KEYS, "left").na.fill(0.0)
    return df.withColumn("unrealized", F.col("units") * F.col("close") - (F.col("bought") - F.col("closed_cost"))).select(*KEYS, "final_equity", "fees", "realized", "unrealized")

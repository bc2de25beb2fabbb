"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import written

_WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, share: float = 1.0) -> DataFrame:
    """``(source, source_size, weight, target)`` from rows ``(source, size)``.

    Sources in order of their code points (null last) take ``weights`` in turn. They share ``share`` of all sizes
    by weight; a target stops at ``most`` times its source's size, and the excess is shared again by weight until
    none is above. The table has a row per source; each sharing round is one aggregation of it to a single row.
    Where every source is capped, what is left is not shared.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = F.array(*[F.lit(float(w)) for w in weights])
    per = written(per.withColumn("weight", F.get(table, (rank % len(weights)).cast("int"))), "sources")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level, cap = -1.0, most * F.col("source_size")
    while True:
        above = F.col("weight") * F.lit(level) > cap
        free, capped = per.agg(F.sum(F.when(~above, F.col("weight"))), F.sum(F.when(above, cap))).first()
        if not free:
            level = math.inf
            break
        now = (total * share - (capped or 0.0)) / free
        if now <= level:
            break
        level = now
    target = cap if math.isinf(level) else F.least(cap, F.col("weight") * F.lit(level))
    return per.select("source", "source_size", "weight", target.cast("double").alias("target"))


def _flight(chance: np.ndarray, size: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The flight phase: moves ``chance`` to 0 or 1 along directions that keep sum(chance) and sum(chance * size).

    Three units at a time; each step settles at least one of them. Returns the new chances and the (two at
    most) units that remain open.
    """
    p, z, u = chance.tolist(), size.tolist(), draw.tolist()
    open_: list[int] = []
    for k in range(len(p)):
        if p[k] <= 0.0 or p[k] >= 1.0:
            continue
        open_.append(k)
        if len(open_) < 3:
            continue
        a, b, c = open_
        d = (z[c] - z[b], z[a] - z[c], z[b] - z[a])
        if d == (0.0, 0.0, 0.0):
            d = (1.0, -1.0, 0.0)
        up = min(((1.0 - p[i]) / v if v > 0 else p[i] / -v) for i, v in zip(open_, d) if v)
        down = min((p[i] / v if v > 0 else (1.0 - p[i]) / -v) for i, v in zip(open_, d) if v)
        step = up if u[k] * (up + down) < down else -down
        for i, v in zip(open_, d):
            p[i] += step * v
            if p[i] < 1e-9:
                p[i] = 0.0
            elif p[i] > 1 - 1e-9:
                p[i] = 1.0
        open_ = [i for i in open_ if 0.0 < p[i] < 1.0]
        if len(open_) == 3:  # rounding left all open: settle the nearest
            i = min(open_, key=lambda x: min(p[x], 1 - p[x]))
            p[i] = float(round(p[i]))
            open_.remove(i)
    return np.array(p), open_


def _landing(start: np.ndarray, chance: np.ndarray, size: np.ndarray, open_: list[int]) -> np.ndarray:
    """The landing phase: settles the open units, then the sum of sizes.

    Of all ways to settle them it takes the one whose sizes sum nearest to what the chances ``start`` give. A long
    document can still leave a gap of half its length; units that had a choice, the largest that fit the gap
    first, are picked or dropped to close it, and what then remains is made up by exchanging a picked unit for one
    that isn't, the pair that fits best, while that helps.
    """
    due = float((start * size).sum()) - float((chance * size).sum())
    best = min(range(1 << len(open_)), key=lambda m: abs(due - sum(size[i] * ((m >> j & 1) - chance[i]) for j, i in enumerate(open_))))
    for j, i in enumerate(open_):
        due -= size[i] * ((best >> j & 1) - chance[i])
        chance[i] = best >> j & 1
    for i in np.argsort(-size, kind="stable").tolist():
        if 0.0 < start[i] < 1.0 and 0.0 < size[i] <= abs(due) and chance[i] == (due < 0):
            due -= size[i] * (1.0 - 2.0 * chance[i])
            chance[i] = 1.0 - chance[i]
    free = np.flatnonzero((start > 0) & (start < 1))
    while abs(due) >= 0.5:
        there, away = free[chance[free] == 1], free[chance[free] == 0]
        if not len(there) or not len(away):
            break
        away = away[np.argsort(size[away], kind="stable")]
        want = size[there] + due
        near = np.clip(np.searchsorted(size[away], want) - np.array([[1], [0]]), 0, len(away) - 1)
        miss = np.abs(size[away][near] - want)
        row, k = np.unravel_index(int(np.argmin(miss)), miss.shape)
        if miss[row, k] >= abs(due) - 1e-9:
            break
        i, j = there[k], away[near[row, k]]
        due -= size[j] - size[i]
        chance[i], chance[j] = 0.0, 1.0
    return chance


def _group_flight(size: str, seed: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    """The flight of one group, and its landing if it is the ``last`` of its stratum."""

    def fly(rows: pa.Table) -> pa.Table:
        order, z = rows["_order"].to_numpy(), rows[size].to_numpy().astype(np.float64)
        rank = np.lexsort((order, -z))  # the largest settle first, so what lands is small
        rows, z = rows.take(pa.array(rank)), z[rank]
        draw = np.random.Generator(np.random.PCG64([seed, len(z), int(order[rank[0]]) & (2**63 - 1)])).random(len(z))
        start = rows["_p"].to_numpy()
        p, open_ = _flight(start, z, draw)
        p = _landing(start, p, z, open_) if last else p
        kept = [c for c in rows.column_names if c not in ("_p", "_order", "_group")]
        return rows.select(kept).append_column("_p", pa.array(p)).append_column("_open", pa.array((p > 0) & (p < 1))).append_column("_order", rows["_order"])

    return fly


def cube_sample(units: DataFrame, stratum: str, chance: str, size: str, order: Column, group_rows: int = 4_000) -> DataFrame:
    """``units`` with ``picked`` (0 or 1): a balanced sample with the inclusion probabilities ``chance``.

    Within each ``stratum``, the number picked and the sum of their ``size`` keep to what the chances give. Units
    are dealt into random groups of about ``group_rows`` by the hash ``order``; each group flies on its own and
    leaves at most two units open. The open units of all groups are dealt and flown again, until one group per
    stratum is left, which lands. A stratum of any size is so many groups: no task holds more than one at a time.
    Rows that tie in ``order`` are equal in all columns used here, so reruns agree. Units of chance 0 or 1 pass.
    """
    kind = units.schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind) + ", _p double, _open boolean, _order bigint"
    now = units.withColumns({"_p": F.col(chance).cast("double"), "_order": order})
    settled: list[DataFrame] = []
    rounds = 0
    while True:
        largest = now.groupBy(stratum).count().agg(F.max("count")).first()[0] or 0
        groups = math.ceil(largest / group_rows)
        last = groups <= 1
        counts = now.groupBy(stratum).agg(F.ceil(F.count("*") / group_rows).alias("_groups"))
        dealt = now.join(counts.withColumnRenamed(stratum, "_s"), F.col(stratum).eqNullSafe(F.col("_s"))).drop("_s")
        dealt = dealt.withColumn("_group", F.pmod(F.xxhash64("_order", F.lit(rounds)), F.col("_groups"))).drop("_groups")

        fly = _group_flight(size, rounds, last)
        flown = written(dealt.groupBy(stratum, "_group").applyInArrow(fly, schema), "flight")
        settled.append(flown.filter("not _open").drop("_open", "_order"))
        now = flown.filter("_open").drop("_open")
        rounds += 1
        if last:
            break
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    return out.withColumn("picked", F.col("_p").cast("int")).drop("_p")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1, 2, 3),
    most: float = 3.0,
    seed: int = 17,
    group_rows: int = 4_000,
) -> DataFrame:
    """One row per row of ``docs``: id, ``size`` (words), ``source``, ``source_size``, ``target`` and ``copies``.

    A document is repeated ``copies`` times in the mix: the whole part of its source's target by size, and one
    more for a balanced sample (cube method) whose chance is the fraction. The words and the documents that each
    source gives so come within a few documents of its target; no document is taken over ``most`` times. A null
    text has size 0; documents without words have copies too, which weigh nothing. A null source is a source. Rows
    of equal source, id and size, such as repeated rows or rows without id, are one unit of the sample: so many of
    them as their chances add up to have a copy more, and the rest of the sum is the unit's chance of one more yet.
    Long texts count their words like all others. An empty table gives no rows.
    """
    sizes = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(_WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.col(source_col).alias("source"),
    )
    sizes = written(sizes, "sizes")
    targets = source_targets(sizes, weights, most).withColumnRenamed("source", "_source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = sizes.groupBy("source", "_id", "size").agg(F.count("*").alias("_rows"))
    joined = units.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "weight")
    joined = joined.withColumns({"_whole": F.floor(ratio + 1e-12).cast("int"), "_more": F.col("_rows") * F.greatest(F.lit(0.0), ratio - F.floor(ratio + 1e-12))})
    joined = joined.withColumns({"_sure": F.floor(F.col("_more") + 1e-9), "_chance": F.greatest(F.lit(0.0), F.col("_more") - F.floor(F.col("_more") + 1e-9))})
    picked = cube_sample(joined, "source", "_chance", "size", F.xxhash64(F.col("_id"), F.col("size"), F.lit(seed)), group_rows)
    small = picked.filter(F.col("_rows") <= _RUN).withColumn("_run", F.lit(0).cast("bigint"))
    rows = small.unionByName(_runs(picked.filter(F.col("_rows") > _RUN), "_rows"))
    rows = rows.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(_RUN), F.col("_rows") - F.col("_run") * _RUN))))
    more = (F.col("_run") * _RUN + F.col("_row") <= F.col("_sure") + F.col("picked")).cast("int")
    return rows.select(F.col("_id").alias(id_col), "size", "source", "source_size", "target", (F.col("_whole") + more).alias("copies"))


_RUN = 100_000  # rows that one row becomes in a task


def _runs(rows: DataFrame, count: str) -> DataFrame:
    """``rows`` of large ``count`` once for each ``_run`` of it, dealt to as many tasks."""
    runs = rows.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(count) - 1) / _RUN))))
    return runs.repartition("_run")


def mixed_documents(docs: DataFrame, broadcast_rows: int = 500_000, **options) -> DataFrame:  # noqa: ANN003
    """The rows of ``docs``, each as many times as the mix takes it; ``options`` are those of ``mix_sources``.

    Rows are told apart by a 128-bit hash of all their columns, not by id: rows without id, of one id, or of one id in several
    sources each have their own copies. Rows that are equal in all columns are one unit, whose copies are dealt out from one of them.
    """
    seen = docs.select(F.struct("*").alias("_row"), *docs.columns) if docs.columns else docs
    key = F.struct(F.xxhash64("_row").alias("a"), F.xxhash64(F.lit(7), "_row").alias("b"))
    seen = seen.withColumn("_key", key)
    taken = mix_sources(seen, id_col="_key", **options)
    taken = written(taken.groupBy("_key").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_same")).filter("_copies > 0"), "mixed")
    if taken.count() <= broadcast_rows:
        taken = F.broadcast(taken)
    rows = seen.select("_row", "_key").join(taken, "_key")
    single = rows.filter("_same = 1").withColumn("_run", F.lit(0).cast("bigint"))
    many = rows.filter("_same > 1").groupBy("_key").agg(F.first("_row").alias("_row"), F.first("_copies").alias("_copies"))
    every = single.select("_row", "_copies", "_run").unionByName(_runs(many, "_copies").select("_row", "_copies", "_run"))
    copies = F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(_RUN), F.col("_copies") - F.col("_run") * _RUN))
    return every.select("_row", F.explode(copies)).select("_row.*")

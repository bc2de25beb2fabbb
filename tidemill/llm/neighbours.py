"""Approximate nearest neighbours by inner product: an inverted multi-index over two halves of the vectors."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import written


@dataclass(frozen=True)
class Settings:
    """``sample`` vectors fit the centroids, and ``probes`` queries, held against all rows, set how many entries a query gathers so that it finds ``recall`` of its neighbours; ``most`` centroids a half, ``block`` entries a task's block, ``chunk`` queries a block and task."""

    sample: int = 16_384
    probes: int = 256
    recall: float = 0.95
    most: int = 256
    block: int = 8_192
    chunk: int = 16_384


def _vectors(column: pa.Array) -> np.ndarray:
    """A list column as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0), flat.dtype)


def _rows(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of rows that take part."""
    element = df.schema[vec_col].dataType.elementType.simpleString()
    vec = F.col(vec_col) if element in ("float", "double") else F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), vec.alias("vec")).filter("id is not null and vec is not null and size(vec) > 0")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.coalesce(finite, F.lit(False)) & F.exists("vec", lambda x: x != 0))


def _usable(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, vec, h1, h2) of rows of ``dim`` parts; h1 and h2 are a 128-bit hash of the vector. Rows of one id count once, with their smallest vector."""
    rows = _rows(df, id_col, vec_col).filter(F.size("vec") == dim).groupBy("id").agg(F.min("vec").alias("vec"))
    return rows.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(7), "vec")})


def _centroids(sample: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's algorithm from distinct sample rows; a centroid without members stays."""
    centres = sample[np.random.default_rng(11).choice(len(sample), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(sample, centres)
        count = np.bincount(own, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centres * centres).sum(1) / 2
    for a in range(0, len(x), 4096):
        out[a : a + 4096] = np.argmin(half - x[a : a + 4096] @ centres.T, axis=1)
    return out


class MultiIndex:
    """Centroids of both halves. A cell is a pair of centroids; ``distances`` of a query are its negative products with them."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right = left, right
        self.k = len(left)

    def cells(self, x: np.ndarray) -> np.ndarray:
        cut = self.left.shape[1]
        return _nearest(x[:, :cut], self.left) * self.k + _nearest(x[:, cut:], self.right)

    def distances(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.left.shape[1]
        return -(q[:, :cut] @ self.left.T), -(q[:, cut:] @ self.right.T)

    def traverse(self, first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> tuple[float, list[int]]:
        """Visits pairs of centroids by summed distance, from a heap, until their cells hold ``wanted`` entries: the last sum, and the cells that aren't empty."""
        k = self.k
        by_first, by_second = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
        one, two = first[by_first].tolist(), second[by_second].tolist()
        rows, columns = (by_first * k).tolist(), by_second.tolist()
        heap, reach = [(one[0] + two[0], 0, 0)], [0] * k  # reach: how many pairs of each first centroid were visited
        found, got, last = [], 0, heap[0][0]
        while heap and got < wanted:
            last, i, j = heapq.heappop(heap)
            cell = rows[i] + columns[j]
            if n := counts[cell]:
                got += n
                found.append(cell)
            reach[i] = j + 1
            if i + 1 < k and reach[i + 1] == j:
                heapq.heappush(heap, (one[i + 1] + two[j], i + 1, j))
            if j + 1 < k and (i == 0 or reach[i - 1] > j + 1):
                heapq.heappush(heap, (one[i] + two[j + 1], i, j + 1))
        return last, found


def _best(scores: np.ndarray, query: np.ndarray, entries: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[float, int]]:
    """The ``k`` (score, id) of largest score, ties to the smaller id. Products are summed exactly and rounded once."""
    if len(scores) > k:
        low = np.partition(scores, -k)[-k]
        near = np.flatnonzero(scores >= low - 1e-9 * max(1.0, abs(low)))
    else:
        near = np.arange(len(scores))
    out = []
    for e in near[np.isfinite(scores[near])].tolist():
        exact = math.fsum((query * entries[e]).tolist())
        out += [(-exact, i) for i in ids[e]]
    return [(-s, i) for s, i in heapq.nsmallest(k, out)]


_HIT = "h1 bigint, h2 bigint, score double, id bigint"


def nearest_neighbours(df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """The ``k`` rows of ``df`` nearest to each row of ``queries`` (both: id, vector) by inner product, but for the row of the query's own id.

    Returns query_id, ``rank`` (from 1), the neighbour's id as ``vec_id``, ``score`` (the product in double precision), nearest first, ties
    to the smaller id; all candidates where there are fewer than ``k``. Vectors that are null, empty, zero or have null or non-finite
    parts take no part, nor do rows without id, nor vectors of another length than most rows have (the longer at a
    tie). Rows that share an id count once, with the smallest of their vectors. Other columns are ignored. Empty tables
    give no rows.

    Equal vectors are one entry with its ``k`` + 1 smallest ids, since no other can be among the nearest, and equal
    queries are searched once; so copies cost nothing. Centroids are fitted on a bounded sample; all vectors are indexed.
    Cells are packed in blocks of bounded size, large ones split; entries and the queries that visit one of a block's cells meet
    there, and every entry of a visited cell is ranked by its exact score. How many entries a query gathers is read
    off the exact neighbours of a bounded set of queries: structureless data take a large share of the table, clustered data a
    small one.
    """
    spark = df.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    lengths = _rows(df, id_col, vec_col).groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    if not lengths:
        return empty
    dim, rows = lengths[0].n, lengths[0]["count"]
    own = Window.partitionBy("h1", "h2").orderBy("id")
    points = _usable(df, id_col, vec_col, dim).withColumn("_r", F.row_number().over(own)).filter(F.col("_r") <= k + 1)
    points = written(points.groupBy("h1", "h2").agg(F.first("vec").alias("vec"), F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    asked = written(_usable(queries, id_col, vec_col, dim), "queries")
    sought = asked.groupBy("h1", "h2").agg(F.first("vec").alias("vec"))

    sample = points.orderBy("h1", "h2").select("vec").limit(settings.sample).toArrow().column("vec")
    sample = _vectors(sample).astype(np.float64)
    if not len(sample):
        return empty
    # about 16 entries a cell, and at least 64 sample vectors a centroid
    centroids = max(1, min(settings.most, round(math.sqrt(rows) / 4), len(sample) // 64))
    cut = dim // 2
    index = spark.sparkContext.broadcast(MultiIndex(_centroids(sample[:, :cut], centroids), _centroids(sample[:, cut:], centroids)))

    counts, wanted = _calibrated(points, sought, index, k, settings)
    blocks = spark.sparkContext.broadcast(_blocks(counts, settings.block))
    visits = written(_visits(sought, index, counts, wanted, blocks), "visits")
    hits = _search(points, visits, index, blocks, k, settings)
    order = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "id")
    hits = hits.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k + 1)
    lists = hits.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("_r", "id", "score"))).alias("found"))
    out = asked.select(F.col("id").alias("query_id"), "h1", "h2").join(lists, ["h1", "h2"])
    found = F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(found).alias("_p", "_x"))
    return out.select("query_id", (F.col("_p") + 1).cast("int").alias("rank"), F.col("_x.id").alias("vec_id"), F.col("_x.score").alias("score"))


def _tasks(df: DataFrame) -> int:
    """The session's shuffle partitions: these tasks are long for their bytes, so they aren't joined by size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _calibrated(points: DataFrame, sought: DataFrame, index, k: int, settings: Settings) -> tuple[np.ndarray, int]:  # noqa: ANN001
    """Entries by cell, and how many a query must gather to find the wanted share of its neighbours.

    One pass over all entries counts them by cell and scores them against the probes; each task keeps the best of every probe.
    """
    chosen = sought.orderBy("h2", "h1").limit(settings.probes).toArrow()
    probes, keys = _vectors(chosen.column("vec")).astype(np.float64), [chosen.column(h).to_numpy() for h in ("h1", "h2")]
    cells = index.value.k ** 2
    asked = points.sparkSession.sparkContext.broadcast((probes, keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, (q, own_keys) = np.zeros(cells, np.int64), asked.value
        best, home = np.full((len(q), 0), 0.0), np.full((len(q), 0), 0)
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                x = _vectors(batch.column("vec").slice(a, 2048)).astype(np.float64)
                own = index.value.cells(x)
                tally += np.bincount(own, minlength=cells)
                if len(q):
                    scores = q @ x.T
                    same = [key[:, None] == batch.column(h).slice(a, 2048).to_numpy() for key, h in zip(own_keys, ("h1", "h2"))]
                    scores[same[0] & same[1]] = -np.inf
                    best, home = np.hstack([best, scores]), np.hstack([home, np.broadcast_to(own, scores.shape)])
                    if best.shape[1] > k:
                        top = np.argpartition(-best, k, axis=1)[:, :k]
                        best, home = np.take_along_axis(best, top, 1), np.take_along_axis(home, top, 1)
        used = np.flatnonzero(tally)
        yield _calibration_rows(np.full(len(used), -1), used, tally[used].astype(np.float64))
        q_at, c_at = np.nonzero(np.isfinite(best))
        yield _calibration_rows(q_at, home[q_at, c_at], best[q_at, c_at])

    table = written(points.select("h1", "h2", "vec").mapInArrow(run, "probe int, cell bigint, value double"), "calibration")
    counts = np.zeros(cells, np.int64)
    for row in table.filter("probe < 0").groupBy("cell").agg(F.sum("value").alias("n")).collect():  # at most a row per cell
        counts[row.cell] = int(row.n)
    order = Window.partitionBy("probe").orderBy(F.desc("value"))
    near = table.filter("probe >= 0").withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).select("probe", "cell").collect()
    needed = []
    first, second = index.value.distances(probes) if len(probes) else (None, None)
    for p in range(len(probes)):
        sums = (first[p][:, None] + second[p][None]).ravel()
        at = np.argsort(sums, kind="stable")
        upto = np.empty(cells, np.int64)
        upto[at] = np.cumsum(counts[at])
        needed += [int(upto[r.cell]) for r in near if r.probe == p]
    needed.sort()
    return counts, needed[min(len(needed) - 1, int(len(needed) * settings.recall))] if needed else int(counts.sum())


def _calibration_rows(probe: np.ndarray, cell: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(probe.astype(np.int32)), pa.array(cell.astype(np.int64)), pa.array(value.astype(np.float64))], names=["probe", "cell", "value"])


def _blocks(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each cell its first block and how many it is dealt to: small cells share a block, neighbours of one first centroid together."""
    first, number, block, room = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, most
    for cell in np.flatnonzero(counts).tolist():
        n = int(counts[cell])
        if n > room and room < most:
            block, room = block + 1, most
        first[cell] = block
        if n > most:
            number[cell] = -(-n // most)
            block, room = block + int(number[cell]), most
        else:
            room -= n
    return first, number


def _visits(sought: DataFrame, index, counts: np.ndarray, wanted: int, blocks) -> DataFrame:  # noqa: ANN001
    """Each query with the last summed distance that it visits, and the blocks of the cells on its way."""
    shared = sought.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = shared.value.tolist()
        first_block, number = blocks.value
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                one, two = index.value.distances(_vectors(part.column("vec")).astype(np.float64))
                far, way = [], []
                for x, y in zip(one, two):
                    last, cells = index.value.traverse(x, y, entries, wanted)
                    far.append(last + 1e-9)  # the sums are formed again, in other batches
                    starts, n = first_block[cells], number[cells]
                    way.append(np.unique(np.concatenate([starts, *(np.arange(a, a + m) for a, m in zip(starts[n > 1].tolist(), n[n > 1].tolist()))])))
                offsets = np.concatenate(([0], np.cumsum([len(w) for w in way])))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate(way).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("h1", "h2", "vec")], pa.array(far, pa.float64()), lists], names=["h1", "h2", "vec", "far", "blocks"])

    kind = sought.schema["vec"].dataType.simpleString()
    return sought.repartition(_tasks(sought), "h1").mapInArrow(run, f"h1 bigint, h2 bigint, vec {kind}, far double, blocks array<bigint>")


def _search(points: DataFrame, visits: DataFrame, index, blocks, k: int, settings: Settings) -> DataFrame:  # noqa: ANN001
    """(h1, h2, score, id): of each query and block the k + 1 best entries of visited cells."""
    kind = points.schema["vec"].dataType.simpleString()

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, number = blocks.value
        for batch in batches:
            x = _vectors(batch.column("vec")).astype(np.float64)
            cells = index.value.cells(x) if len(x) else np.empty(0, np.int64)
            own = first[cells] + batch.column("h2").to_numpy().astype(np.uint64) % number[cells].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), pa.array(cells), *[batch.column(c) for c in ("h1", "h2", "vec", "ids")]], names=["block", "cell", "h1", "h2", "vec", "ids"])

    entries = points.mapInArrow(dealt, f"block bigint, cell bigint, h1 bigint, h2 bigint, vec {kind}, ids array<bigint>")
    visited = visits.select("h1", "h2", "vec", "far", F.explode("blocks").alias("block"))
    chunks = visits.select(F.explode("blocks").alias("block")).groupBy("block").agg(F.ceil(F.count("*") / settings.chunk).cast("int").alias("chunks"))
    entries = entries.join(chunks, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("kind"), "h1", "h2", "vec", "cell", "ids", F.lit(0.0).alias("far"))
    visited = visited.join(chunks, "block").select("block", F.pmod(F.col("h2"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("kind"), "h1", "h2", "vec", F.lit(0).cast("bigint").alias("cell"), F.array().cast("array<bigint>").alias("ids"), "far")
    both = entries.unionByName(visited).repartition(_tasks(points), "block", "chunk").sortWithinPartitions("block", "chunk", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("block", "chunk", "kind")])
            edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                part, place = batch.slice(a, b - a), tuple(key[:2, a].tolist())
                if place != now:
                    now, held, ready = place, [], None
                if key[2, a] == 0:
                    held.append(part)
                    continue
                if ready is None:
                    table = pa.Table.from_batches(held)
                    ready = (_vectors(table.column("vec")).astype(np.float64), table.column("cell").to_numpy(), table.column("ids").to_pylist()) if held else ()
                if not ready:
                    continue
                x, cells, ids = ready
                for c in range(0, part.num_rows, 256):
                    asked = part.slice(c, 256)
                    q = _vectors(asked.column("vec")).astype(np.float64)
                    one, two = index.value.distances(q)
                    far = one[:, cells // index.value.k] + two[:, cells % index.value.k]
                    scores = np.where(far <= asked.column("far").to_numpy()[:, None], q @ x.T, -np.inf)
                    found = [_best(scores[r], q[r], x, ids, k + 1) for r in range(len(q))]
                    per = [len(f) for f in found]
                    flat = [h for f in found for h in f]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked.column(h).to_numpy(), per)) for h in ("h1", "h2")] + [pa.array([s for s, _ in flat], pa.float64()), pa.array([i for _, i in flat], pa.int64())], names=["h1", "h2", "score", "id"])

    return both.mapInArrow(run, _HIT)

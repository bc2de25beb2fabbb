"""N-gram Jaccard join with a count-vector R-tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._graph import components
from ._store import written

_U = np.uint64


def _group_bits(band: int, num: int, den: int) -> int:
    """How many top bits of a hash name its group, for sets of 2 ** band shingles and more (below the next band).

    About a third more groups than the largest set of the band has to have; for small sets, where chance counts
    most, so many that each shingle is a group.
    """
    if band < 5:
        return 16
    most, bits = _differing(1 << (band + 1), num, den) + 1, max(6, band - 1)
    while (1 << bits) < 1.35 * most:
        bits += 1
    return bits


def _differing(n: int, num: int, den: int) -> int:
    """The most shingles in which a set of ``n`` can differ from one that it links with."""
    return (den - num) * (n + n * den // num) // (den + num)


def _group_keys(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of a set such that two sets with Jaccard similarity of ``num/den`` or more share one.

    In a band of sizes, hashes fall into groups by their top bits. Sets that link differ in at most r shingles, so
    of the first r + 1 groups in which the smaller has any, one is the same in both. A set whose partners reach
    the next band has keys there too. A set needs r + 1 groups that aren't empty; there are so many more groups
    that random hashes miss this with a chance below 1e-14.
    """
    n = len(s)
    widest = n * den // num
    r = _differing(n, num, den)
    mixed, out = _text.mix(s), []
    for band in range(n.bit_length() - 1, widest.bit_length()):
        bits = _group_bits(band, num, den)
        g = s >> _U(64 - bits)
        at = np.flatnonzero(g[1:] != g[:-1]) + 1
        at = np.concatenate((np.zeros(1, np.int64), at))
        end = at[r + 1] if len(at) > r + 1 else n
        at = at[: r + 1]
        sums = np.add.reduceat(mixed[:end], at)
        out.append(_text.mix(sums + _text.mix(g[at] + _U(band << 40))))
    return np.concatenate(out)


def _vector(s: np.ndarray) -> np.ndarray:
    """Counts of the set by the low bits of its hashes: 64 groups, for larger sets 4 to 8 shingles a group.

    The group count has to grow with the set, or the counts of unrelated large sets differ too little to part them.
    """
    dims = max(64, 1 << (len(s) // 8).bit_length())
    return np.bincount((s & _U(dims - 1)).astype(np.int64), minlength=dims).astype(np.uint16)


def _stacked(vectors: list[np.ndarray]) -> np.ndarray:
    """Vectors as rows of one matrix, each folded to the fewest groups that any has (which adds counts)."""
    dims = min(map(len, vectors))
    out = np.empty((len(vectors), dims), np.int32)
    for k, v in enumerate(vectors):
        out[k] = v.reshape(-1, dims).sum(axis=0) if len(v) > dims else v
    return out


def _shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for a, _, data, offsets in _text.pieces(column):
        yield a, _text.shingles(*_text.hashed_words(data, offsets), k)


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    flat = np.concatenate(values) if values else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _points(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(id, n, s1, s2, vec, keys): size, two hashes of the set, its count vector and its group keys."""

    def point(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, sets in _shingle_sets(batch.column(1), k):
                sums = [[int(s.sum(dtype=np.uint64)), int(_text.mix(s + _U(7)).sum(dtype=np.uint64))] if len(s) else [0, 0] for s in sets]
                sums = np.array(sums, dtype=np.uint64).view(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(sums[:, 0]),
                        pa.array(sums[:, 1]),
                        pa.array([_vector(s).tobytes() for s in sets], pa.binary()),
                        _lists([_group_keys(s, num, den) if len(s) else s for s in sets]),
                    ],
                    ["id", "n", "s1", "s2", "vec", "keys"],
                )

    return docs.mapInArrow(point, "id bigint, n bigint, s1 bigint, s2 bigint, vec binary, keys array<bigint>")


class CountRTree:
    """A packed R-tree over count vectors.

    Points are tiled by set size, then by their first coordinates, into leaves; a node keeps the largest of each
    coordinate and the smallest size below it. The overlap of a set with any set below a node is at most the
    sum over coordinates of the smaller of its count and the node's largest.
    """

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, num: int, den: int, fan: int = 16):
        self.num, self.den, self.fan = num, den, fan
        slab = np.zeros(len(sizes), np.int64)
        by_size = np.argsort(sizes, kind="stable")
        slab[by_size] = np.arange(len(sizes)) // max(fan, int(np.sqrt(len(sizes) * fan)))
        self.rows = np.lexsort((vectors[:, 1 % vectors.shape[1]], vectors[:, 0], slab))
        self.levels = [(vectors[self.rows], sizes[self.rows])]
        while len(self.levels[-1][1]) > 1:
            high, low = self.levels[-1]
            at = np.arange(0, len(low), fan)
            self.levels.append((np.maximum.reduceat(high, at, axis=0), np.minimum.reduceat(low, at)))

    def search(self, vectors: np.ndarray, sizes: np.ndarray, block: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, row) whose overlap can be what the similarity asks for."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        top = len(self.levels) - 1
        work = [(top, np.arange(len(sizes)), np.zeros(len(sizes), np.int64))]
        while work:
            level, q, node = work.pop()
            if len(q) > block:
                work += [(level, q[a : a + block], node[a : a + block]) for a in range(0, len(q), block)]
                continue
            high, low = self.levels[level]
            bound = np.minimum(vectors[q], high[node]).sum(axis=1, dtype=np.int64)
            live = (self.num + self.den) * bound >= self.num * (sizes[q] + low[node])
            q, node = q[live], node[live]
            if not len(q):
                continue
            if not level:
                found.append((q, self.rows[node]))
                continue
            child = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
            q = np.repeat(q, self.fan)
            inside = child < len(self.levels[level - 1][1])
            work.append((level - 1, q[inside], child[inside]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _can_link(a: list[np.ndarray], b: list[np.ndarray], n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of vectors, whose sets have ``n`` shingles together, can link by their summed coordinate minima."""
    dims = np.array([min(len(x), len(y)) for x, y in zip(a, b)])
    out = np.zeros(len(a), bool)
    for d in np.unique(dims).tolist():
        own = np.flatnonzero(dims == d)
        x, y = (np.stack([v[k].reshape(-1, d).sum(axis=0) for k in own.tolist()]) for v in (a, b))
        out[own] = (num + den) * np.minimum(x, y).sum(axis=1, dtype=np.int64) >= num * n[own]
    return out


def _overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection sizes of the pairs (a, b) of sorted sets."""
    if len(a) <= 8 * len(sets):
        out = np.empty(len(a), np.int64)
        for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
            both = np.sort(np.concatenate((sets[i], sets[j])), kind="stable")
            out[k] = np.count_nonzero(both[1:] == both[:-1])
        return out
    values, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = counts[place] > 1
    place, owner = np.cumsum(counts > 1)[place[shared]] - 1, owner[shared]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    step = 2048
    for c in range(0, int(place[-1]) + 1 if len(place) else 0, step):
        x, y = np.searchsorted(place, (c, c + step))
        has = np.zeros((len(sets), step), np.float32)
        has[owner[x:y], place[x:y] - c] = 1.0
        total += has @ has.T
    return total[a, b].astype(np.int64)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Pairs that connect what all the pairs connect, fewer than ``n``."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for i, j in zip(a.tolist(), b.tolist()):
        x, y = root(i), root(j)
        if x != y:
            up[x] = y
            out.append((i, j))
    return out


def _linking(sets: list[np.ndarray], n: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (a, b), some that link and connect what all that link connect.

    Each round verifies at most one pair for every row, of rows that earlier links don't connect yet; a group of near
    copies so takes about as many verifications as it has rows.
    """
    root, ka, kb = np.arange(len(sets)), [], []
    while len(a):
        _, first = np.unique(b, return_index=True)
        x, y = a[first], b[first]
        same = _overlaps(sets, x, y)
        hit = den * same >= num * (n[x] + n[y] - same)
        ka.append(x[hit])
        kb.append(y[hit])
        for i, j in zip(root[x[hit]].tolist(), root[y[hit]].tolist()):
            i, j = root[i], root[j]
            while root[i] != i:
                i = root[i]
            while root[j] != j:
                j = root[j]
            root[max(i, j)] = min(i, j)
        while not np.array_equal(root, root[root]):
            root = root[root]
        left = np.ones(len(a), bool)
        left[first] = False
        left &= root[a] != root[b]
        a, b = a[left], b[left]
    return (np.concatenate(ka), np.concatenate(kb)) if ka else (a, b)


def _join_tiles(num: int, den: int, k: int | None = None, links: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Joins the rows of each (component, i, j), which arrive together: tile i with tile j, or with itself.

    Rows have their set size and count vector, or for ``k`` words their text, of which the sets are made here. Pairs
    pass the R-tree; sets are compared too, and then every row gets the number of links (by copies) that it has
    here, if ``links`` are asked for; else pairs of rows that others connect aren't verified. Pairs leave as a forest
    that connects the same rows. Of rows that repeat an id one counts.
    """
    verify = k is not None

    def group(rows: pa.Table) -> tuple[list[int], list[int | None], list[int]]:
        tile = rows["tile"].to_numpy()
        i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
        ids, own = np.unique(rows["id"].to_numpy(), return_index=True)
        rows, tile = rows.take(pa.array(own)), tile[own]
        copies = rows["copies"].to_numpy()
        if verify:
            sets = [s for _, part in _shingle_sets(rows["text"].combine_chunks(), k) for s in part]
            n, vec = np.array([len(s) for s in sets], np.int64), _stacked([_vector(s) for s in sets])
        else:
            n, vec = rows["n"].to_numpy(), _stacked([np.frombuffer(v, np.uint16) for v in rows["vec"].to_pylist()])
        left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
        if not len(left) or not len(right):
            return [], [], []
        a, b = CountRTree(vec[right], n[right], num, den).search(vec[left], n[left])
        a, b = left[a], right[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        ua: list[int] = []
        ub: list[int | None] = []
        uw: list[int] = []
        if verify and not links:
            a, b = _linking(sets, n, a, b, num, den)
        elif verify and len(a):
            same = _overlaps(sets, a, b)
            linked = den * same >= num * (n[a] + n[b] - same)
            a, b = a[linked], b[linked]
            weight = np.bincount(a, copies[b], len(ids)) + np.bincount(b, copies[a], len(ids))
            own = np.flatnonzero(weight)
            ua, ub, uw = ids[own].tolist(), [None] * len(own), weight[own].astype(np.int64).tolist()
        for x, y in _forest(a, b, len(ids)):
            ua.append(int(ids[x]))
            ub.append(int(ids[y]))
            uw.append(0)
        return ua, ub, uw

    def two(batch: pa.RecordBatch, at: np.ndarray) -> tuple[list[int], list[int | None], list[int]]:
        """All groups of two rows of a batch at once, without verifying."""
        if not len(at):
            return [], [], []
        ids, n = batch.column("id").to_numpy(), batch.column("n").to_numpy()
        vec = batch.column("vec")
        both = [[np.frombuffer(v, np.uint16) for v in vec.take(pa.array(at + k)).to_pylist()] for k in (0, 1)]
        live = at[_can_link(*both, n[at] + n[at + 1], num, den)]
        return ids[live].tolist(), ids[live + 1].tolist(), [0] * len(live)

    def out(found: tuple[list[int], list[int | None], list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.int64())], ["u", "v", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("component", "i", "j")])
            cuts = (np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()
            if held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in ("component", "i", "j")):
                yield out(group(pa.Table.from_batches(held)))
                held = []
            found: tuple[list, list, list] = ([], [], [])
            inner = np.array([0, *cuts], np.int64)
            pair = np.flatnonzero(np.diff(inner) == 2) if not verify else np.empty(0, np.int64)
            pair = pair[pair > 0] if held else pair
            for x, y in zip(found, two(batch, inner[pair])):
                x.extend(y)
            done = set(inner[pair].tolist())
            for a, b in zip([0, *cuts], cuts):
                if a in done:
                    continue
                held.append(batch.slice(a, b - a))
                for x, y in zip(found, group(pa.Table.from_batches(held))):
                    x.extend(y)
                held = []
            yield out(found)
            held.append(batch.slice(cuts[-1] if cuts else 0))
        if held:
            yield out(group(pa.Table.from_batches(held)))

    return run


def _near_leader(num: int, den: int, k: int | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(component, leader, id) of the rows that can link with their component's leader by their count vectors, or, for
    ``k`` words, that do by their texts."""

    def bounded(batch: pa.RecordBatch) -> np.ndarray:
        both = [[np.frombuffer(v, np.uint16) for v in batch.column(c).to_pylist()] for c in ("vec", "leader_vec")]
        return _can_link(*both, batch.column("n").to_numpy() + batch.column("leader_n").to_numpy(), num, den)

    def linked(batch: pa.RecordBatch) -> np.ndarray:
        _, first, at = np.unique(batch.column("component").to_numpy(), return_index=True, return_inverse=True)
        leaders = [s for _, part in _shingle_sets(batch.column("leader_text").take(pa.array(first)), k) for s in part]
        out = []
        for a, own in _shingle_sets(batch.column("text"), k):
            sets, mine = [*own, *leaders], len(own) + at[a : a + len(own)]
            n = np.array([len(s) for s in sets], np.int64)
            same = _overlaps(sets, np.arange(len(own)), mine)
            out.append((same > 0) & (den * same >= num * (n[: len(own)] + n[mine] - same)))
        return np.concatenate(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 1_024):
                part = batch.slice(a, 1_024)
                near = (bounded if k is None else linked)(part)
                yield part.select(["component", "leader", "id"]).filter(pa.array(near))

    return run


def _followers(members: DataFrame, rows: DataFrame, near: Callable, large: int, few: Callable[[DataFrame], DataFrame], leader_mb: int = 64) -> DataFrame | None:
    """(component, leader, id): members of components of more than ``large`` rows that link with the component's leader,
    its smallest id, which is one of them; None without such components.

    ``rows`` (id and what ``near`` compares) are read once. What followers have in common with each other isn't asked:
    the leader connects them. Leaders are broadcast up to ``leader_mb``.
    """
    own = [c for c in rows.columns if c != "id"]
    sizes = members.groupBy("component").agg(F.count("*").alias("_n"), F.min("id").alias("leader"))
    sizes = written(sizes.filter(F.col("_n") > large).select("component", "leader"), "large")
    led = rows.select(F.col("id").alias("leader"), *[F.col(c).alias(f"leader_{c}") for c in own])
    led = written(led.join(few(sizes), "leader").dropDuplicates(["component"]), "leaders")
    payload = F.octet_length(f"leader_{own[-1]}")
    n, size = led.agg(F.count("*"), F.sum(payload + 64)).first()
    if not n:
        return None
    inside = members.join(few(sizes.select("component")), "component").select("component", "id")
    met = rows.join(few(inside), "id").join(F.broadcast(led) if size <= leader_mb << 20 else led, "component")
    return written(met.mapInArrow(near, "component bigint, leader bigint, id bigint").distinct(), "followers")


def _tiles(members: DataFrame, tile_rows: int, followers: DataFrame | None) -> DataFrame:
    """``members`` (component, id, copies) of components of two and more, once for each pair (i, j) of tiles that they are in.

    A component has tiles of about ``tile_rows`` members, followers in tiles of their own. Tiles of followers meet only
    those of others, so a component of followers alone has none.
    """
    led = F.lit(False)
    if followers is not None:
        members, led = members.join(followers.select("component", "id", F.lit(True).alias("_led")), ["component", "id"], "left"), F.coalesce("_led", F.lit(False))
    members = members.select("component", "id", "copies", led.alias("led"))
    tiles = lambda mine: F.ceil(F.count_if(mine) / tile_rows).cast("int")
    sizes = members.groupBy("component").agg(tiles(~F.col("led")).alias("tiles"), tiles(F.col("led")).alias("led_tiles"), F.count("*").alias("_n"))
    tiled = members.join(sizes.filter("_n > 1 and tiles > 0"), "component")
    tile = F.when(F.col("led"), F.col("tiles") + F.pmod(F.xxhash64("id"), F.greatest("led_tiles", F.lit(1)))).otherwise(F.pmod(F.xxhash64("id"), "tiles"))
    last = F.col("tiles") - 1 + F.when(F.col("led"), 0).otherwise(F.col("led_tiles"))
    tiled = tiled.withColumn("tile", tile.cast("int")).select("*", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    return tiled.select("component", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "id", "copies")


def _edges(pairs: DataFrame, followers: DataFrame | None) -> DataFrame:
    pairs = pairs.select("u", "v")
    return pairs if followers is None else pairs.union(followers.select("leader", "id"))


def _within(rows: DataFrame, join: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """(u, v, w) from all pairs of tiles: the rows of each meet in one task, one pair after another."""
    met = rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    return met.mapInArrow(join, "u bigint, v bigint, w bigint")


def _blocks(keys: DataFrame, few: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(component, id): the rows that share a key, once for each set of rows that share any.

    Keys are counted by partition first. Those of two rows say which two; only keys of more are looked up again,
    and of keys with the same rows one is kept.
    """
    shared = written(keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("rows")).filter("low < high"), "shared")
    two = shared.filter("rows = 2").select("low", "high").distinct()
    two = two.select(F.xxhash64("low", "high").alias("component"), F.explode(F.array("low", "high")).alias("id"))
    many = written(keys.join(few(shared.filter("rows > 2").select("key")), "key").distinct(), "many")
    alike = many.groupBy("key").agg(F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("members"), F.count("*").alias("rows"))
    alike = alike.groupBy("members", "rows").agg(F.min("key").alias("key")).select("key")
    return two.union(many.join(few(alike), "key").select(F.col("key").alias("component"), "id"))


def ngram_jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = 5,
    num: int = 80,
    den: int = 100,
    tile_rows: int = 512,
    broadcast_rows: int = 100_000,
    broadcast_keys: int = 500_000,
    links: bool = True,
) -> DataFrame:
    """Links of documents whose sets of ``k``-word shingles have Jaccard similarity of ``num/den`` or more.

    One row per row of ``docs``: id, ``n_shingles`` (set size), ``component_id`` (the smallest id reachable by links,
    its own included) and, if ``links``, ``n_links`` (documents it links with, equal sets included). Without it pairs
    of documents that other links connect aren't verified.

    Shingles are hashed into groups. Documents that can link share a group's content, which routes them into blocks
    without comparing all with all. In each block, the counts of groups are points of an R-tree and the
    summed coordinate minima bound the overlap; what surviving pairs connect is a candidate class. The texts of
    those are read again, and every pair in a class that survives the bound is verified. Documents
    with equal sets are one point. Large blocks, and without ``links`` large classes, have a leader, whom all rows are
    held against first: what it links with it connects, so only pairs with one of the other rows are compared after
    that. These, and where link counts are asked for all pairs of a class, are joined by pairs of tiles of ``tile_rows``
    points; no pair leaves a task, only link counts and a spanning forest. Tables of at most ``broadcast_rows`` rows, and
    keys alone (8 bytes each) up to ``broadcast_keys``, are broadcast.

    Texts of fewer than ``k`` words have their whole word sequence as one shingle; null texts and texts without
    words have none and link with nothing. Long texts are hashed part by part. A row without id gets its set size, no
    component and no links. Rows that repeat an id are copies of one document and should have the same text; of
    different texts under one id, one stands for the id where it is compared. Other columns are ignored; an empty
    table gives no rows. Similarities under 0.7 are refused, and ids have to be whole numbers.
    """
    if 10 * num < 7 * den or num > den:
        raise ValueError("the similarity has to be from 0.7 to 1")
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    points = written(_points(source, k, num, den), "points")
    known = points.filter("id is not null and n > 0")
    classes = written(known.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")

    few = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    few_keys = lambda df: F.broadcast(df) if df.count() <= broadcast_keys else df
    singles = classes.select(F.col("rep").alias("id"), "copies")
    blocks = written(_blocks(known.select(F.explode("keys").alias("key"), "id"), few_keys).join(singles, "id"), "blocks")
    vectors = known.select("id", "n", "vec")
    followers = _followers(blocks, vectors, _near_leader(num, den), 4 * tile_rows, few)
    tiles = written(_tiles(blocks, 4 * tile_rows, followers), "tiles")
    rough = vectors.join(few(tiles), "id")
    parted = components(_edges(_within(rough, _join_tiles(num, den)), followers))
    finer = written(parted.withColumnRenamed("node", "id").join(singles, "id"), "finer")
    followers = None if links else _followers(finer, source, _near_leader(num, den, k), tile_rows, few)
    tiles = written(_tiles(finer, tile_rows, followers), "tiles")
    exact = source.join(few(tiles), "id").select("component", "i", "j", "tile", "id", "copies", "text")
    verified = written(_within(exact, _join_tiles(num, den, k, links)), "verified")
    linked = components(_edges(verified.filter("v is not null"), followers))
    counts = verified.filter("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("w").alias("links"))

    classes = classes.join(linked.withColumnRenamed("node", "rep"), "rep", "left").join(counts, "rep", "left")
    classes = classes.select("n", "s1", "s2", F.coalesce("component", "rep").alias("component_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = points.select("id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"], "left")
    has = F.col("id").isNotNull()
    count = F.when(has, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("n_links")
    return out.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(has, F.coalesce("component_id", "id")).alias("component_id"),
        *([count] if links else []),
    )

"""Nearest neighbours against brute force."""

import math
from collections import defaultdict

import numpy as np
import pytest

from tidemill.llm import neighbours, queries
from tidemill.llm.neighbours import MultiIndex, Settings, nearest_neighbours

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, asked, k):
    """{query: [(rank, id, score)]} over usable (id, vector) rows."""
    usable = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            v = [float(np.float32(x)) for x in v]
            usable[i] = min(usable.get(i, v), v)
    out = {}
    for q in {i for i in asked if i in usable}:
        scores = sorted((-math.fsum(a * b for a, b in zip(usable[q], v)), i) for i, v in usable.items() if i != q)
        out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


def lists(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.query_id].append((r["rank"], r.vec_id, r.score))
    return {q: sorted(x) for q, x in out.items()}


def test_traversal_is_in_order():
    rng = np.random.default_rng(1)
    index = MultiIndex(rng.normal(size=(7, 3)), rng.normal(size=(7, 3)))
    for q in rng.normal(size=(20, 6)):
        one, two = (d[0] for d in index.distances(q[None]))
        sums = (one[:, None] + two[None]).ravel()
        counts = rng.integers(0, 4, 49).tolist()
        for wanted in (1, 10, 10**6):
            last, found = index.traverse(one, two, counts, wanted)
            order = [c for c in np.argsort(sums).tolist() if counts[c]]
            assert found == order[: len(found)]
            assert sum(counts[c] for c in found) >= min(wanted, sum(counts)) and sum(counts[c] for c in found[:-1]) < wanted
            assert last >= max(sums[found])


def test_all_entries_give_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(400, 9)).round(1).tolist()
    rows = [(i, v, 0) for i, v in enumerate(vectors)]
    rows += [(1000 + i, vectors[40], 0) for i in range(0, 90)] + [(2000 + i, vectors[41], 1) for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    small = Settings(sample=256, probes=8, recall=1.0, block=32, chunk=8)
    got = lists(nearest_neighbours(df, df.filter("vec_id % 20 = 0"), 7, settings=small))
    want = brute([r[:2] for r in rows], [r[0] for r in rows if r[0] % 20 == 0], 7)
    assert got.keys() == want.keys()
    hit = total = 0
    for q, w in want.items():
        assert [x[0] for x in got[q]] == list(range(1, 8))
        total += 7
        hit += len({x[1] for x in w} & {x[1] for x in got[q]})
        scores = {i: s for _, i, s in brute([r[:2] for r in rows if r[0] in {x[1] for x in got[q]} | {q}], [q], 99)[q]}
        assert all(s == scores[i] for _, i, s in got[q])
        assert got[q] == sorted(got[q], key=lambda x: (-x[2], x[1]))
    assert hit / total > 0.95
    whole = lists(nearest_neighbours(df, df.filter("vec_id in (20, 40, 1000, 1001)"), 7, settings=Settings(most=1, block=32)))
    assert whole == brute([r[:2] for r in rows], [20, 40, 1000, 1001], 7)


def test_edge_cases(spark):
    rows = [(0, [1.0, 0.0, 2.0]), (20, [0.0, 0.0, -0.0]), (40, None), (60, [None, 1.0, 1.0]), (80, [float("nan"), 1.0, 1.0]), (100, [float("inf"), 1.0, 1.0]), (120, [1.0, 2.0]), (140, []), (None, [1.0, 1.0, 1.0]),
            (3, [2.0, 0.0, 1.0]), (3, [2.0, 0.0, 1.0]), (5, [1.0, 5.0, 0.0]), (5, [1.0, 1.0, 0.0]), (160, [-1.0, 0.0, 0.0]), (160, [-1.0, 0.0, 0.0]), (7, [2.0, 0.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, id string, h1 int")
    got = lists(nearest_neighbours(df, df.filter("vec_id % 20 = 0"), 3))
    same = [r for r in rows if r[1] and len(r[1]) == 3]
    assert got == brute(same, [0, 160], 3) and [x[1] for x in got[0]] == [3, 7, 5]
    assert nearest_neighbours(df.limit(0), df.limit(0)).collect() == []
    one = df.filter("vec_id = 0")
    assert nearest_neighbours(one, one).collect() == []
    assert lists(nearest_neighbours(df, df.filter("vec_id = 99"), 3)) == {}
    doubles = spark.createDataFrame([(i, [i / 7, 1.0]) for i in range(30)], "vec_id int, embedding array<double>")
    assert [r.vec_id for r in nearest_neighbours(doubles, doubles.filter("vec_id = 0"), 4).orderBy("rank").collect()] == [1, 2, 3, 4]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_registered_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    got = lists(queries.op11_nearest_neighbours(spark, f"/root/testdata/{sf}"))
    asked = [i for i, _ in rows if i % 20 == 0]
    assert sorted(got) == sorted(asked) and all(len(x) == 20 for x in got.values())
    want = brute(rows, asked[:60], 20)
    recall = np.mean([len({x[1] for x in w} & {x[1] for x in got[q]}) / 20 for q, w in want.items()])
    assert recall >= 0.9
    vectors = dict(rows)
    for q in asked[:60]:
        assert all(s == math.fsum(a * b for a, b in zip(vectors[q], vectors[i])) for _, i, s in got[q])


def test_copies_meet_once(spark):
    """A vector that half of all rows have costs its 21 smallest ids and one search."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist() if i % 2 else [1.0, 1.0, 1.0, 1.0], 0) for i in range(4_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = lists(nearest_neighbours(df, df.filter("vec_id % 20 = 0"), 20))
    assert len(got) == 200
    points = neighbours._usable(df, "vec_id", "embedding", 4)
    assert points.select("h1", "h2").distinct().count() == 2_001
    asked = [0, 20, 3_980]
    want = brute([r[:2] for r in rows], asked, 20)
    assert all(len({x[1] for x in want[q]} & {x[1] for x in got[q]}) >= 17 for q in asked)

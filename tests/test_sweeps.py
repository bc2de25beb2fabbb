"""Intervals, identities, records and grids against plain loops."""

import random
from datetime import datetime, timedelta
from itertools import product

import pytest
from pyspark.sql import functions as F

from tidemill.operators import identity, intervals, segments, signals
from tidemill.sources import archives

from .test_bars import bars

T0 = datetime(2020, 1, 1)
H = timedelta(hours=1)


def made(rng, n, longest):
    out = []
    for _ in range(n):
        start = T0 + timedelta(minutes=rng.randint(0, 60 * 24 * 900))
        out.append((start, start + timedelta(minutes=rng.randint(0, longest))))
    return out


@pytest.mark.parametrize("seed,longest", [(1, 50), (2, 60 * 24 * 40), (3, 60 * 24 * 900)])
def test_overlaps_of_any_length(spark, seed, longest):
    rng = random.Random(seed)
    a, b = made(rng, 60, longest), made(rng, 60, 3_000)
    b += a[:5] + [(a[0][1], a[0][1] + H), (a[1][0], a[1][1] + H), (a[2][0], a[2][0])]
    schema = "start timestamp_ntz, end timestamp_ntz"
    got = sorted((r.start, r.end) for r in intervals.common_breaks(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect())
    assert got == sorted((max(s, t), min(e, f)) for s, e in a for t, f in b if s < f and t < e and s < e and t < f)


def test_touching_intersections_join(spark):
    schema = "start timestamp_ntz, end timestamp_ntz"
    a = spark.createDataFrame([(T0, T0 + 10 * H), (T0 + 20_000 * H, T0 + 20_010 * H)], schema)
    b = spark.createDataFrame([(T0 + k * H, T0 + (k + 1) * H) for k in (2, 3, 4, 7, 20_000, 20_001)], schema)
    got = sorted((r.start, r.end) for r in intervals.common_intervals(a, b).collect())
    assert got == [(T0 + 2 * H, T0 + 5 * H), (T0 + 7 * H, T0 + 8 * H), (T0 + 20_000 * H, T0 + 20_002 * H)]


@pytest.mark.parametrize("own", [True, False])
def test_rows_in_intervals(spark, own):
    rng = random.Random(7)
    held = [(rng.choice(["A", "B", None]), *i) for i in made(rng, 40, 60 * 24 * 30)] + [("A", T0, T0), ("B", T0 + 9 * H, T0 + 8 * H)]
    rows = [(rng.choice(["A", "B", "C", None]), T0 + timedelta(minutes=rng.randint(0, 60 * 24 * 900)), k) for k in range(300)]
    rows += [("A", s, 1_000 + k) for k, (_, s, _) in enumerate(held)] + [("A", e, 2_000 + k) for k, (_, _, e) in enumerate(held)] + [("A", None, 3_000)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, k int")
    iv = spark.createDataFrame(held, "symbol string, start timestamp_ntz, end timestamp_ntz")
    iv = iv if own else iv.drop("symbol")
    inside = lambda symbol, ts: ts is not None and any((not own or s == symbol and s is not None) and a <= ts < b for s, a, b in held)
    want = {k for symbol, ts, k in rows if inside(symbol, ts)}
    assert {r.k for r in segments.inside_intervals(df, iv).collect()} == want
    assert {r.k for r in segments.outside_intervals(df, iv).collect()} == {k for *_, k in rows} - want


def test_identity_tree_is_extended(spark):
    df, rows = bars(spark, 700, gaps=(5,))
    other, _ = bars(spark, 3, seed=2, symbol="B")
    every = df.unionByName(other)
    whole = {r.symbol: (r.rows, r.dataset_id) for r in identity.tree_identity(identity.tree_frontier(every.repartition(5), run=8), "v1", 8).collect()}
    assert whole["A"][0] == 699 and whole["B"][0] == 3
    frontier, cuts = None, [0, 1, 64, 65, 300, 512, 700]
    for a, b in zip(cuts[:-1], cuts[1:]):
        part = every.filter((F.col("ts") >= F.lit(datetime(2024, 1, 1) + a * H)) & (F.col("ts") < F.lit(datetime(2024, 1, 1) + b * H)))
        rows_ = [tuple(r) for r in identity.tree_frontier(part, frontier, 8).collect()]
        frontier = spark.createDataFrame(rows_, "symbol string, level int, place bigint, h string")
        low = [r for r in rows_ if r[0] == "A" and r[1] < 4]
        assert max([sum(r[1] == k for r in low) for k in range(4)]) < 8
    assert {r.symbol: (r.rows, r.dataset_id) for r in identity.tree_identity(frontier, "v1", 8).collect()} == whole
    changed = every.withColumn("close", F.when(F.col("ts") == F.lit(datetime(2024, 1, 1) + 333 * H), F.col("close") + 1).otherwise(F.col("close")))
    again = {r.symbol: r.dataset_id for r in identity.tree_identity(identity.tree_frontier(changed, run=8), "v1", 8).collect()}
    assert again["A"] != whole["A"][1] and again["B"] == whole["B"][1]


def records(spark, *rows):
    return spark.createDataFrame(rows, "experiment_id string, hypothesis string, fee double, slip double")


def test_records_are_written_once(spark, tmp_path):
    path = f"file://{tmp_path}/once"
    one, two = ("e1", "h", 0.1, 0.0), ("e2", "h", 0.2, 0.0)
    assert archives.committed(spark, path) is None
    assert archives.commit_experiments(records(spark, one, one), path) == 1
    assert archives.commit_experiments(records(spark, one), path) == 0
    assert archives.commit_experiments(records(spark, one, two), path) == 2
    with pytest.raises(ValueError):
        archives.commit_experiments(records(spark, ("e1", "h", 0.9, 0.0), ("e3", "h", 0.1, 0.0)), path)
    with pytest.raises(ValueError):
        archives.commit_experiments(records(spark, ("e4", "h", 0.9, 0.0), ("e4", "h", 0.8, 0.0)), path)
    assert sorted(tuple(r) for r in archives.committed(spark, path).collect()) == [one, two]
    assert archives.commit_experiments(records(spark, one).limit(0), path) == 0


def test_a_crash_before_the_commit_leaves_nothing(spark, tmp_path, monkeypatch):
    path, row, moved = f"file://{tmp_path}/crash", ("e1", "h", 0.1, 0.0), archives._moved

    def crash(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(archives, "_moved", crash)
    with pytest.raises(RuntimeError):
        archives.commit_experiments(records(spark, row), path)
    assert archives.committed(spark, path) is None and list((tmp_path / "crash").glob("_staged-*"))
    monkeypatch.setattr(archives, "_moved", moved)
    assert archives.commit_experiments(records(spark, row), path) == 1
    assert [tuple(r) for r in archives.committed(spark, path).collect()] == [row]


def test_two_writers_take_turns(spark, tmp_path, monkeypatch):
    path, moved, other = f"file://{tmp_path}/two", archives._moved, []

    def late(session, staged, target):
        if not other:
            other.append(1)
            archives.commit_experiments(records(spark, ("e1", "h", 0.1, 0.0), ("e2", "h", 0.1, 0.0)), path)
        return moved(session, staged, target)

    monkeypatch.setattr(archives, "_moved", late)
    assert archives.commit_experiments(records(spark, ("e1", "h", 0.1, 0.0), ("e3", "h", 0.1, 0.0)), path) == 2
    assert sorted(r.experiment_id for r in archives.committed(spark, path).collect()) == ["e1", "e2", "e3"]
    assert not list((tmp_path / "two").glob("_staged-*"))


@pytest.mark.parametrize("name", ["hyp0005", "hyp0010", "hyp0013", "hyp0016", "hyp0021", "hyp0022", "hyp0023"])
def test_factorised_grids_equal_all_cells(spark, name):
    """Each bar against each cell by the rule as it stands."""
    df, _ = bars(spark, 260, seed=4)
    seg = segments.continuous_segments(df, "1 hour")
    signal = signals.SIGNALS[name]
    rule, _ = signals._bound(signal.rule, signal, signal.grid)
    cells = signals.param_grid(spark, signal.grid).select("cell", F.struct(*signal.grid).alias("p"))
    features = signals.features_for(seg, (signal, signal.grid))
    want = features.crossJoin(cells).filter(f"bar_idx >= {signal.first} and {rule}")
    want = {(r.bar_idx, r.cell, tuple(r.p)) for r in want.select("bar_idx", "cell", "p").collect()}
    got = [(r.bar_idx, r.cell, tuple(r.params)) for r in signals.evaluate_grid(seg, name).collect()]
    assert set(got) == want and len(got) == len(want) and got
    values = list(product(*[[float(v) for v in vs] for vs in signal.grid.values()]))
    assert all(values[c] == p for _, c, p in got)

"""Long segments: blocks of any length give the results of plain loops, and a symbol is many tasks."""

import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemill.operators import accounting, event_study, indicators, metrics, scans, segments

from .test_bars import bars, walk

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("block", [24, 50, 100_000])
def test_segments_across_blocks(spark, block):
    rng = random.Random(block)
    rows, want = [], {}
    for symbol in "AB":
        at, run, place, before = 0, -1, 0, None
        for _ in range(400):
            at += 1 if rng.random() < 0.97 else rng.randint(2, 200)
            run, place = (run, place + 1) if before is not None and at == before + 1 else (run + 1, 0)
            before = at
            rows.append((symbol, T0 + timedelta(hours=at), float(at)))
            want[symbol, float(at)] = (run, place)
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, close double").repartition(4)
    got = segments.continuous_segments(df, "1 hour", block=block).collect()
    assert {(r.symbol, r.close): (r.segment_id, r.bar_idx) for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("block", [5, 64, 10_000])
def test_running_values(spark, block):
    rng = random.Random(3)
    rows = [(k, i, rng.choice([None, rng.randint(-9, 9)])) for k in (None, "a", "b") for i in sorted(rng.sample(range(900), 250))]
    df = spark.createDataFrame(rows, "k string, i int, x int")
    values = {"total": ("sum", F.col("x")), "peak": ("max", F.col("x")), "latest": ("last", F.col("x"))}
    got = {(r.k, r.i): (r.total, r.peak, r.latest) for r in scans.running(df, ["k"], "i", F.floor(F.col("i") / block), values).collect()}
    want, state = {}, {}
    for k, i, x in rows:
        s = state.get(k, (None, None, None))
        if x is not None:
            s = ((s[0] or 0) + x, x if s[1] is None else max(s[1], x), x)
        want[k, i] = state[k] = s
    assert got == want
    alone = scans.running(df.filter("k = 'a'"), [], "i", F.floor(F.col("i") / block), values)
    assert {r.i: r.latest for r in alone.collect()} == {i: v[2] for (k, i), v in want.items() if k == "a"}


@pytest.mark.parametrize("block", [1, 7, 1_000])
def test_windows_over_blocks(spark, block):
    df, rows = bars(spark, 300, gaps=(90, 91))
    seg = segments.continuous_segments(df, "1 hour")
    build = lambda d: d.withColumns({"mean": indicators.sma(20), "next": F.lead("close", 2).over(segments.ordered())})
    got = scans.over_blocks(seg, build, 20, 2, block).orderBy("ts").collect()
    assert len(got) == len(rows)
    for part in (got[:90], got[90:]):
        close = [r.close for r in part]
        for k, r in enumerate(part):
            assert r.mean == (pytest.approx(statistics.fmean(close[k - 19 : k + 1])) if k >= 19 else None)
            assert r.next == (close[k + 2] if k + 2 < len(close) else None)
    assert got[0].segment_id == 0 and got[-1].segment_id == 1


@pytest.mark.parametrize("block", [50, 10_000])
def test_order_statistics(spark, block):
    rng = random.Random(6)
    x = [rng.choice([None, 1.0, 2.0, 3.0, rng.random()]) if rng.random() < 0.3 else float(rng.randint(0, 5)) for _ in range(400)]
    seg = spark.createDataFrame([("A", 0, i, v) for i, v in enumerate(x)] + [("B", 0, i, v) for i, v in enumerate(x[:30])], "symbol string, segment_id bigint, bar_idx bigint, x double")
    got = indicators.moving_order(seg, {"m": ("median", "x", 9), "r": ("rank", "x", 12)}, 40, block).orderBy("symbol", "bar_idx").collect()
    assert [r.x for r in got] == x + x[:30]
    for r in got:
        k = r.bar_idx
        before = [v for v in x[max(0, k - 9) : k] if v is not None]
        assert r.m == (statistics.median(before) if before else None)
        refs, last = x[max(0, k - 13) : max(0, k - 1)], x[k - 1] if k else None
        whole = len(refs) == 12 and None not in refs and last is not None
        assert r.r == (sum(v <= last for v in refs) / 12 if whole else None)


def first_come(rows):
    out, last = set(), {}
    for k, i, s in sorted(set(rows)):
        if k not in last or i - last[k] >= s:
            out.add((k, i))
            last[k] = i
    return out


@pytest.mark.parametrize("block", [3, 10, 64, 100_000])
@pytest.mark.parametrize("spacing", [(2, 2), (5, 5), (24, 24), (1, 30)])
def test_first_come_selection_by_blocks(spark, block, spacing):
    rng = random.Random(block)
    rows = [(k, i, rng.randint(*spacing)) for k, share in (("a", 1.0), ("b", 0.5), ("c", 0.05)) for i in range(20, 400) if rng.random() < share]
    df = spark.createDataFrame(rows + rows[:50], "k string, bar_idx bigint, spacing int").repartition(3)
    got = [(r.k, r.bar_idx) for r in event_study.select_non_overlapping(df, ["k"], block=block).collect()]
    assert set(got) == first_come(rows) and len(got) == len(set(got))
    assert event_study.select_non_overlapping(df.limit(0), ["k"], block=block).collect() == []


@pytest.fixture
def apart(spark):
    """Small partitions aren't joined."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_selection_of_one_long_run_is_many_tasks(spark, apart):
    df = spark.range(300_000).select(F.lit(1).alias("k"), F.col("id").alias("bar_idx"), F.lit(7).alias("spacing"))
    got = event_study.select_non_overlapping(df, ["k"], block=5_000)
    tasks = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in tasks) == -(-300_000 // 7) and len(tasks) > 4 and max(r["count"] for r in tasks) < 300_000 / 7 / 2
    assert got.filter("bar_idx % 7 <> 0").count() == 0


@pytest.mark.parametrize("block", [11, 100_000])
@pytest.mark.parametrize("delay", [1, 2])
def test_fractional_campaigns(spark, block, delay):
    df, rows = bars(spark, 250, seed=9)
    rng = random.Random(delay)
    t = [rng.choice([0.0, 0.0, 0.25, 0.5, 1.0]) if k % 60 > 20 else 0.5 for k in range(len(rows))]
    targets = spark.createDataFrame(list(enumerate(t)), "bar_idx bigint, target double")
    seg = segments.continuous_segments(df, "1 hour").join(targets, "bar_idx").withColumn("cell", F.lit(0).cast("bigint"))
    fills = accounting.fractional_fills(seg, delay, 0.001, 0.0005, block=block)
    equity, pnls = walk(rows, t, delay, 0.001, 0.0005, 1000.0)
    assert [r.equity for r in accounting.equity_curve(seg, fills).orderBy("bar_idx").collect()] == pytest.approx(equity, rel=1e-9)
    assert accounting.fifo_match(fills).agg(F.sum("pnl")).first()[0] == pytest.approx(sum(pnls), rel=1e-6)


def test_one_symbol_is_many_blocks(spark):
    """What a window holds together is a block and its halo, however long the segment."""
    n = 400_000
    df = spark.range(n).select(F.lit("A").alias("symbol"), F.expr("timestamp_ntz '2000-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id as int))").alias("ts"), (F.col("id") % 97 + 1.0).alias("close"))
    seg = segments.continuous_segments(df, "1 minute", block=20_000)
    groups = []

    def build(d):
        groups.extend(d.groupBy("symbol", "segment_id").count().collect())
        return d.withColumn("mean", indicators.sma(24))

    out = scans.over_blocks(seg, build, 24, block=20_000).agg(F.count("*").alias("n"), F.max("bar_idx").alias("last"), F.count("mean").alias("means")).first()
    assert (out.n, out.last, out.means) == (n, n - 1, n - 23)
    assert len(groups) >= n / 20_000 and max(g["count"] for g in groups) <= 20_024


def test_account_over_many_days(spark):
    rng = random.Random(2)
    day = lambda k: (T0 + timedelta(days=k)).date()
    a, b = [[(day(k), 100 + rng.random() * 50) for k in range(3_000)] for _ in "ab"]
    schema = "date date, value double"
    got = metrics.account_vs_benchmark(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "2024-01-01").first()
    low = lambda rows: min(v / max(x for _, x in rows[: k + 1]) - 1 for k, (_, v) in enumerate(rows))
    assert got.account_max_drawdown == pytest.approx(low(a)) and got.benchmark_max_drawdown == pytest.approx(low(b))

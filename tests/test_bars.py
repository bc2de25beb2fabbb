"""Bar operators against plain loops, worked examples and the rule that the future changes nothing."""

import random
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from tidemill.functions import columns as C
from tidemill.operators import accounting, allocation, event_study, indicators, metrics, quality, robustness, segments, signals
from tidemill.plans import fixtures

T0 = datetime(2024, 1, 1)


def bars(spark, n=400, gaps=(), seed=1, symbol="A"):
    rng = random.Random(seed)
    price, rows = 100.0, []
    for i in range(n):
        o = price * (1 + rng.uniform(-0.02, 0.02))
        c = o * (1 + rng.uniform(-0.03, 0.03))
        rows.append((symbol, T0 + timedelta(hours=i), o, max(o, c) * (1 + rng.random() / 100), min(o, c) * (1 - rng.random() / 100), c, 10 + 90 * rng.random()))
        price = c
    rows = [r for i, r in enumerate(rows) if i not in gaps]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    return df, rows


def test_segments_end_at_gaps(spark):
    df, _ = bars(spark, 20, gaps=(5, 6, 12))
    got = segments.continuous_segments(df, "1 hour").groupBy("segment_id").count().orderBy("segment_id").collect()
    assert [r["count"] for r in got] == [5, 5, 7]


@pytest.mark.parametrize("block", [4, 256])
def test_exponential_mean_equals_recursion(spark, block):
    df, rows = bars(spark, 300)
    seg = segments.continuous_segments(df, "1 hour")
    got = [r.m for r in indicators.ewm(seg, "close", 0.1, "m", 0, block).orderBy("bar_idx").collect()]
    m = rows[0][5]
    for g, r in zip(got, rows):
        m = r[5] if r is rows[0] else 0.1 * r[5] + 0.9 * m
        assert g == pytest.approx(m, rel=1e-10)


@pytest.mark.parametrize("name", ["hyp0005", "hyp0008", "hyp0009", "hyp0012", "hyp0019", "hyp0021", "hyp0025"])
def test_future_changes_nothing(spark, name):
    df, rows = bars(spark, 200)
    grid = {k: v[:1] for k, v in signals.SIGNALS[name].grid.items()}
    short = df.filter(F.col("ts") < F.lit(rows[150][1]))
    run = lambda d: {r.bar_idx for r in signals.evaluate_grid(segments.continuous_segments(d, "1 hour"), name, grid).collect()}
    assert run(short) == {i for i in run(df) if i < 150}


def test_registered_grids():
    sizes = [signals.grid_size(*[f"hyp{n:04d}" for n in ns]) for ns in ((1, 2, 3, 4), (5, 6, 7), (8, 9, 10), (11, 12, 13), (14, 15, 16), (17, 18, 19), (20, 21, 22), (23, 24, 25))]
    assert sizes == [90, 45, 45, 33, 26, 28, 40, 28]


def test_walk_takes_first_come(spark):
    rng = random.Random(2)
    rows = [(c, i) for c in range(30) for i in sorted(rng.sample(range(200), rng.randint(1, 90)))]
    df = spark.createDataFrame(rows, "cell int, bar_idx bigint")
    got = {(r.cell, r.bar_idx) for r in event_study.select_non_overlapping(df, ["cell"], F.lit(5)).collect()}
    want = set()
    for c in range(30):
        last = -99
        for k, i in rows:
            if k == c and i - last >= 5:
                want.add((c, i))
                last = i
    assert got == want


def walk(rows, targets, delay, fee, slip, cash):
    units, lots, out, pnls = 0.0, [], [], []
    for i, r in enumerate(rows):
        o, c = r[2], r[5]
        if i >= delay:
            gap = (cash + units * o) * targets[i - delay] - units * o
            if gap > 1e-12:
                q = gap / (1 + fee) / (o * (1 + slip))
                cash, units = cash - gap, units + q
                lots.append([q, gap])
            elif gap < -1e-12 and units > 0:
                p = o * (1 - slip)
                q = units if targets[i - delay] == 0 else min(units, -gap / p)
                cash, units, left = cash + q * p * (1 - fee), units - q, q
                while left > 1e-12 and lots:
                    x = min(left, lots[0][0])
                    cost = lots[0][1] * x / lots[0][0]
                    pnls.append(x * p * (1 - fee) - cost)
                    lots[0][0], lots[0][1], left = lots[0][0] - x, lots[0][1] - cost, left - x
                    if lots[0][0] < 1e-12:
                        lots.pop(0)
        out.append(cash + units * c)
    return out, pnls


def _targets(spark, values, seed=3):
    df, rows = bars(spark, 150, seed=seed)
    rng = random.Random(seed)
    t = [rng.choice(values) for _ in rows]
    seg = segments.continuous_segments(df, "1 hour").join(spark.createDataFrame([(i, v) for i, v in enumerate(t)], "bar_idx bigint, target double"), "bar_idx")
    return seg.withColumn("cell", F.lit(0).cast("bigint")), rows, t


@pytest.mark.parametrize("delay", [1, 2])
def test_binary_accounting_equals_walk(spark, delay):
    df, rows, t = _targets(spark, [0.0, 1.0])
    got = accounting.binary_accounting(df, delay, 0.001, 0.0005).orderBy("bar_idx").collect()
    equity, pnls = walk(rows, t, delay, 0.001, 0.0005, 1000.0)
    assert [r.equity for r in got] == pytest.approx(equity, rel=1e-9)
    assert [r.trade_pnl for r in got if r.trade_pnl is not None] == pytest.approx(pnls, rel=1e-6, abs=1e-6)


def test_fractional_accounting_equals_walk(spark):
    df, rows, t = _targets(spark, [0.0, 0.25, 0.5, 1.0])
    fills = accounting.fractional_fills(df, 1, 0.001, 0.0005).cache()
    equity, pnls = walk(rows, t, 1, 0.001, 0.0005, 1000.0)
    curve = accounting.equity_curve(df, fills).orderBy("bar_idx").collect()
    assert [r.equity for r in curve] == pytest.approx(equity, rel=1e-9)
    lots = accounting.fifo_match(fills).orderBy("sell_idx", "buy_idx").collect()
    assert sum(r.pnl for r in lots) == pytest.approx(sum(pnls), rel=1e-6)
    assert len(lots) == len(pnls)


def test_metric_examples(spark):
    eq = spark.createDataFrame([("A", i, v) for i, v in enumerate([100.0, 110.0, 99.0, 105.0, 111.0])], "symbol string, bar_idx int, equity double")
    assert metrics.max_drawdown(eq, ["symbol"]).first().max_drawdown == pytest.approx(0.1)
    assert metrics.recovery_periods(eq, ["symbol"]).first().recovery_periods == 2
    assert metrics.longest_recovery(eq, ["symbol"]).first().longest_recovery == 2
    trades = spark.createDataFrame([("A", 1, 10.0), ("A", 2, -5.0), ("A", 3, -5.0), ("A", 4, 0.0)], "symbol string, k int, pnl double")
    s = metrics.trade_stats(trades, ["symbol"]).first()
    assert (s.win_rate, s.profit_factor, s.expectancy) == (0.25, 1.0, 0.0)
    assert metrics.losing_streak(trades, ["symbol"], "k").first().losing_streak == 2


def test_net_return_and_violations(spark):
    row = spark.range(1).select(C.net_return(F.lit(100.0), F.lit(110.0), F.lit(0.001), F.lit(0.0005)).alias("r")).first()
    assert row.r == pytest.approx(110 * 0.9995 / (100 * 1.0005) * 0.999**2 - 1)
    raw = [("A", "z", "m", k + 1, f) for k, f in enumerate([["open time", "1", "2", "3", "4", "5"], [""], ["1518168494789", "1", "1", "1", "1", "1"], ["1518166800000", "2", "1", "1", "1", "1"], ["1518170400000", "1", "1", "1", "1", "-1"], ["1518174000000", "1", "1"], ["NaN", "1", "1", "1", "1", "1"], ["1518177600000", "1", "2", "0.5", "1", "1"], ["1518188400000", "1", "2", "0.5", "1", "1"], ["1518188400000", "1", "2", "0.5", "1", "1"]])]
    rows = quality.normalize_klines(spark.createDataFrame(raw, "symbol string, archive string, member string, row_no bigint, fields array<string>"))
    got = sorted((r.anomaly_type, r.row_no) for r in quality.scan_quality(rows).collect() if r.row_no)
    assert got == [("DUPLICATE_TIMESTAMP", 10), ("INVALID_OHLC", 4), ("INVALID_VOLUME", 5), ("NON_ALIGNED_TIMESTAMP", 3), ("SCHEMA_ERROR", 1), ("SCHEMA_ERROR", 6), ("SCHEMA_ERROR", 7)]
    assert quality.scan_gaps(rows).count() == 2


def test_rebalance_and_decision(spark):
    w = spark.createDataFrame([("A", 0.5), ("B", 0.0), ("C", 0.25)], "symbol string, weight double")
    h = spark.createDataFrame([("B", 300.0), ("C", 250.4), ("D", 5.0)], "symbol string, value double")
    plan = [(r.symbol, r.side, r.notional) for r in allocation.rebalance(w, h, 1000.0, 1.0).orderBy("seq").collect()]
    assert plan == [("B", "sell", 300.0), ("D", "sell", 5.0), ("A", "buy", 500.0)]
    dims = spark.createDataFrame([("x", True, True), ("y", True, None)], "hyp string, a boolean, b boolean")
    assert {r.hyp: (r.decision, r.failed) for r in robustness.decide(dims, ["hyp"]).collect()} == {"x": ("PASS", []), "y": ("FAIL", ["b"])}


def test_first_come_selection_equals_walk(spark):
    rng = random.Random(8)
    rows = sorted({(k, rng.randint(0, 4000)) for k in "ab" for _ in range(1500)})
    df = spark.createDataFrame(rows, "k string, bar_idx bigint").withColumn("spacing", F.lit(3))
    want = []
    for k in "ab":
        last = -10
        for _, i in [r for r in rows if r[0] == k]:
            if i - last >= 3:
                want.append((k, i))
                last = i
    assert sorted((r.k, r.bar_idx) for r in event_study.select_non_overlapping(df, ["k"]).collect()) == want


def test_exponential_mean_of_one_bar_and_of_many(spark):
    df, rows = bars(spark, 1500, seed=4)
    seg = segments.continuous_segments(df, "1 hour")
    got = indicators.ema(indicators.ema(seg, 1, out="one"), 200, out="many").orderBy("bar_idx").collect()
    mean = None
    for r in got:
        assert r.one == r.close
        mean = r.close if mean is None else mean + (r.close - mean) * 2 / 201
        assert r.many == pytest.approx(mean, rel=1e-9)


def test_stacked_windows_share_one_shuffle(spark):
    seg = segments.continuous_segments(fixtures.daily_bars(spark, "/root/testdata/sf0.001"), "1 day")
    df = indicators.with_base_columns(seg).withColumns({"a": indicators.sma(5), "b": indicators.prior_median("volume", 5), "c": indicators.range_ratio(5)})
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Window [") >= 4
    shuffles = lambda d: d._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(symbol")
    assert shuffles(df) <= shuffles(seg) + 1


def test_bars_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    """Means and sums are those of decimals, rounded once, whatever the order and the number of files."""
    rng = random.Random(3)
    rows = [("A", T0 + timedelta(days=d), round(rng.uniform(1e6, 9e6), 2), float(rng.randint(1, 50)), rng.choice("FO")) for d in range(20) for _ in range(300)]
    rows += [("A", T0 + timedelta(days=20), None, 1.0, "F"), ("A", T0 + timedelta(days=20), 7.25, 2.0, "O"), ("A", T0 + timedelta(days=20), 0.25, 2.0, "O")]

    def mean(prices):
        exact = sum(map(Decimal, map(str, prices))) / len(prices)
        return float(exact.quantize(Decimal("1e-8"), ROUND_HALF_UP))

    want = {}
    for day in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == day and r[2] is not None]
        sides = [[r[2] for r in own if r[4] == side] or [r[2] for r in own] for side in "FO"]
        want[day] = (*map(mean, sides), sum(r[3] for r in rows if r[1] == day))
    for k, order in enumerate((rows, rows[::-1], sorted(rows, key=lambda r: r[2] or 0))):
        df = spark.createDataFrame(order, "l_returnflag string, l_shipdate timestamp_ntz, l_extendedprice double, l_quantity double, l_linestatus string")
        df.coalesce(1 + k).write.parquet(f"{tmp_path}/{k}/lineitem.parquet")
        got = {r.ts: (r.open, r.close, r.volume) for r in fixtures.daily_bars(spark, f"{tmp_path}/{k}").collect()}
        assert got == want


def test_bars_take_each_kind_of_row_once(spark, tmp_path):
    """Equal rows are counted before prices meet in objects, and quartiles, means and volumes count each of them as often."""
    rng = random.Random(4)
    rows = [("A", T0 + timedelta(days=d), float(rng.randint(1, 9)), float(rng.randint(1, 3)), rng.choice("FO")) for d in range(3) for _ in range(400)]
    df = spark.createDataFrame(rows, "l_returnflag string, l_shipdate timestamp_ntz, l_extendedprice double, l_quantity double, l_linestatus string")
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    bars_ = fixtures.daily_bars(spark, str(tmp_path))
    for r in bars_.collect():
        own = sorted(x[2] for x in rows if x[1] == r.ts)
        at = lambda p: own[int(p)] + (own[int(p) + 1] - own[int(p)]) * (p - int(p))  # noqa: B023, E731
        sides = [[x[2] for x in rows if x[1] == r.ts and x[4] == s] for s in "FO"]
        first, last = (sum(s) / len(s) for s in sides)
        assert (r.open, r.close) == (pytest.approx(first, abs=1e-8), pytest.approx(last, abs=1e-8))
        assert (r.high, r.low) == (pytest.approx(max(first, last, at(0.75 * 399)), abs=1e-8), pytest.approx(min(first, last, at(0.25 * 399)), abs=1e-8))
        assert r.volume == sum(x[3] for x in rows if x[1] == r.ts)
    import re

    plan = bars_._jdf.queryExecution().optimizedPlan().toString()
    kinds = [line for line in plan.splitlines() if re.search(r"\bAggregate \[", line)]
    assert len(kinds) == 2 and "percentile" in kinds[0] and "percentile" not in kinds[1]

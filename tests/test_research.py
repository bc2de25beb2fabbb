"""From raw rows to decisions, and what every operator must not know: the future."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemill.operators import event_study, intervals, metrics, quality, research, scans, segments, signals
from tidemill.operators import indicators as I
from tidemill.plans import fixtures
from tidemill.sources import archives
from tidemill.sources.store import shared_path, written

SF = "/root/testdata/sf0.01"
T0 = datetime(2024, 1, 1)
SINGLE = tuple(n for n in signals.BASES if n != "hyp0006")


def ms(hour):
    return str(int((T0 + timedelta(hours=hour) - datetime(1970, 1, 1)).total_seconds() * 1000))


def test_treated_bars(spark):
    """An hour with an event has no bar, nor have the hours up to two clean ones in a row; a row without a time breaks nothing."""
    rows = []
    for symbol in "AB":
        for h in range(24):
            if symbol == "A" and h == 5:
                continue  # a gap
            fields = [ms(h), "10", "12", "9", "11", "5"]
            if symbol == "A" and h == 12:
                fields[2] = "8"  # high under low
            if symbol == "B" and h == 3:
                fields[0] = "?"
            rows.append((symbol, f"{symbol}.zip", f"{symbol}.csv", h, fields))
            if symbol == "B" and h == 20:
                rows.append((symbol, f"{symbol}.zip", f"{symbol}.csv", 100, fields))  # twice
    raw = spark.createDataFrame(rows, "symbol string, archive string, member string, row_no bigint, fields array<string>")
    bars, breaks = research.treated_bars(quality.normalize_klines(raw), "2025-01-01")
    got = {s: [] for s in "AB"}
    for r in bars.orderBy("ts").collect():
        got[r.symbol].append(int((r.ts - T0).total_seconds() // 3600))
    assert got["A"] == [h for h in range(24) if h not in (5, 12)]
    assert got["B"] == [h for h in range(24) if h not in (3, 20)]
    assert sorted((r.symbol, r.start.hour, r.end.hour) for r in breaks.collect()) == [("A", 5, 6), ("A", 12, 13), ("B", 3, 4), ("B", 20, 21)]


def test_empty_rows(spark):
    raw = spark.createDataFrame([], "symbol string, archive string, member string, row_no bigint, fields array<string>")
    bars, breaks = research.treated_bars(quality.normalize_klines(raw), "2025-01-01")
    assert bars.count() == breaks.count() == 0
    seg = written(segments.continuous_segments(bars, "1 hour"), "segments")
    out = research.cycle_decisions(research.decide_hypotheses(seg, ("hyp0005",)), {"1": ("hyp0005",)})
    assert {(r.hypothesis, r.decision) for r in out.collect()} == {("hyp0005", None), ("overall", "FAIL")}


def decisions(spark, **passed):
    rows = [(n, [] if ok else ["timing"], 8, 8 if ok else 7, "PASS" if ok else "FAIL") for n, ok in passed.items()]
    return spark.createDataFrame(rows, "hypothesis string, failed array<string>, required int, passed int, decision string")


def test_cycles(spark):
    """All must pass, or one in a candidate cycle; who has no decision fails."""
    cycles = {"a": ("h1", "h2"), "b": ("h3", "h4"), "c": ("h5",), "d": ("h6", "h7")}
    out = research.cycle_decisions(decisions(spark, h1=True, h2=True, h3=True, h4=False, h5=False, h6=True), cycles, ("c", "d")).collect()
    total = {r.cycle: (r.decision, r.required, r.passed, r.failed) for r in out if r.hypothesis == "overall"}
    assert total == {"a": ("PASS", 2, 2, []), "b": ("FAIL", 2, 1, ["h4"]), "c": ("FAIL", 1, 0, ["h5"]), "d": ("PASS", 1, 1, ["h7"])}
    assert len(out) == 11


def test_records_are_written_once(spark):
    path, cycles = shared_path(spark, "records"), {"a": ("h1", "h2")}
    first = research.cycle_decisions(decisions(spark, h1=True, h2=False), cycles)
    assert research.commit_decisions(first, path, "v1") == 1
    assert research.commit_decisions(first, path, "v1") == 0
    changed = research.cycle_decisions(decisions(spark, h1=True, h2=True), cycles)
    with pytest.raises(ValueError):
        research.commit_decisions(changed, path, "v1")
    assert research.commit_decisions(changed, path, "v2") == 2
    assert archives.committed(spark, path).count() == 6


def test_certify_each(spark):
    events = spark.createDataFrame([("x", "issue 1"), ("x", "issue 2"), ("y", "issue 1"), ("y", None), (None, "issue 1")], "archive string, source_provenance string")
    every = spark.createDataFrame([("x",), ("y",), ("z",)], "archive string")
    got = {r.archive: r.certification for r in quality.certify(events, "issue", every).collect()}
    assert got == {"x": quality.DOCUMENTED, "y": quality.UNUSABLE, "z": quality.VALID}
    assert quality.certify(events.limit(0), "issue").first().certification == quality.VALID
    assert quality.certify(events, "issue").first().certification == quality.UNUSABLE


def test_common_labels(spark):
    t = lambda h: T0 + timedelta(hours=h)
    labels = spark.createDataFrame([(s, p, c) for p in ("p", "q") for s, c in (("a", "VALID"), ("b", "VALID"), ("c", "UNUSABLE"), ("d", "UNVERIFIED"))], "symbol string, name string, certification string")
    certified = spark.createDataFrame([("a", t(0), t(4)), ("b", t(2), t(9)), ("c", t(4), t(6)), ("d", t(0), t(9))], "symbol string, start timestamp_ntz, end timestamp_ntz")
    parts = spark.createDataFrame([("p", t(0), t(4)), ("q", t(4), t(9))], "name string, start timestamp_ntz, end timestamp_ntz")
    got = {(r.symbol_a, r.symbol_b, r.name): r.certification for r in intervals.common_certifications(labels, certified, parts).collect()}
    assert len(got) == 12
    assert got["a", "b", "p"] == "VALID" and got["a", "b", "q"] == "UNUSABLE" and got["a", "c", "p"] == "UNUSABLE"
    assert got["b", "c", "q"] == "VALID WITH DOCUMENTED EXCLUSIONS" and got["a", "d", "p"] == got["c", "d", "q"] == "UNVERIFIED"


def test_metric_inputs(spark):
    rows = [("ok", 1, 5.0, 0.0), ("ok", 2, -1.0, 1.0), ("none", 1, 5.0, None), ("some", 1, 5.0, None), ("some", 2, 5.0, 0.5), ("out", 1, 0.0, -0.1), ("zero", 1, 0.0, 1.0), ("zero", 2, 1.0, 1.0)]
    eq = spark.createDataFrame(rows, "k string, bar_idx int, equity double, position double")
    every = spark.createDataFrame([(k,) for k in ("ok", "none", "some", "out", "zero", "gone")], "k string")
    got = {r.k: r.error for r in metrics.validate_metrics_input(eq, ["k"], universe=every).collect()}
    assert got == {"ok": None, "none": None, "some": "positions are incomplete", "out": "a position is outside 0 to 1", "zero": "equity starts at zero or less", "gone": "no equity"}


@pytest.fixture(scope="module")
def runs(spark):
    """All daily bars in segments, and those before a cut within a long one."""
    bars = written(fixtures.daily_bars(spark, SF), "bars")
    cut = "1999-03-04"
    early = bars.filter(F.col("ts") < F.lit(cut).cast("timestamp_ntz"))
    return cut, written(segments.continuous_segments(bars, "1 day"), "all"), written(segments.continuous_segments(early, "1 day"), "early")


def same(whole, early, cut, by="ts"):
    kept = whole.filter(F.col(by) < F.lit(cut).cast("timestamp_ntz"))
    assert early.count() == kept.count() > 0
    assert early.exceptAll(kept.select(early.columns)).count() == 0


def test_signals_and_events_do_not_know_the_future(spark, runs):
    """Hits of all 20 grids on single bars, and events that are over before the cut, are those of the bars before it."""
    cut, seg, early = runs
    hits = [written(signals.evaluate_grids(df, SINGLE).withColumn("cell", F.hash("hypothesis").cast("bigint") * 1000 + F.col("cell")), "hits") for df in (seg, early)]
    same(*hits, cut)
    events = [event_study.run_events(h, df, event_study.stress_grid(spark)) for h, df in zip(hits, (seg, early))]
    same(events[0], events[1], cut, "exit_ts")


def test_indicators_do_not_know_the_future(runs):
    cut, *both = runs
    columns = {
        "sma": I.sma(24), "max": I.prior_extreme("close", 12), "min": I.prior_extreme("close", 12, False), "norm": I.norm_range(24), "mv": I.prior_median("volume", 24),
        "ma": I.prior_abs_ret_median(24), "rv": I.prior_realized_vol(12), "exp": I.range_expansion(24), "regime": I.regime(), "gap": I.opening_gap(), "vm": I.volume_to_mean(20), "ret": I.ret(24),
    }
    made = []
    for seg in both:
        df = scans.over_blocks(seg, lambda d: I.with_base_columns(d).withColumns(columns))
        for step in (lambda d: I.ema(d, 24), I.atr, I.rsi, I.vwap_bands, I.prior_rank):
            df = step(df)
        made.append(written(df, "indicators"))
    same(made[0], made[1], cut)


def test_grids_together_are_each_alone(spark, runs):
    """No feature of one grid takes the name of another's: median volume and median volatility of 12 bars both occur."""
    names = ("hyp0009", "hyp0019")
    count = lambda df: {(r.cell, r["count"]) for r in df.groupBy("cell").count().collect()}
    both = written(signals.evaluate_grids(runs[1], names), "hits")
    for name in names:
        alone = count(signals.evaluate_grid(runs[1], name))
        assert alone and count(both.filter(F.col("hypothesis") == name)) == alone

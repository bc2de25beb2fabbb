"""The win classifier of the registered query."""

import inspect
import math
import random

import pytest

from pyspark.sql import functions as F

from tidemill.operators import classifier
from tidemill.plans import registry


def test_query_fits_all_trees(spark, monkeypatch):
    own, seen = classifier.fit_win_filter, []

    def spy(*args, **kwargs):
        bound = inspect.signature(own).bind(*args, **kwargs)
        bound.apply_defaults()
        seen.append(bound.arguments)
        raise InterruptedError

    monkeypatch.setattr(classifier, "fit_win_filter", spy)
    with pytest.raises(InterruptedError):
        registry.queries()["q_L2_L3"](spark, "/root/testdata/sf0.001")
    assert (seen[0]["trees"], seen[0]["depth"], seen[0]["rate"], seen[0]["seed"]) == (100, 3, 0.05, 42)


@pytest.fixture(scope="module")
def trades(spark):
    """400 trades whose result follows two features and some chance."""
    rnd, rows = random.Random(5), []
    for k in range(400):
        x = [rnd.random() for _ in range(5)]
        won = x[0] + 0.5 * x[2] + 0.3 * rnd.random() > 0.9
        rows.append((k, "A" if k % 3 else "B", *x, 1.92 if won else -1.08))
    return spark.createDataFrame(rows, ["ts", "symbol", *classifier.FEATURES, "result"]).cache()


def test_model_is_the_sum_of_its_trees(trades):
    """Predictions are those of a loop over the trees, more trees fit better, and the model beats the plain rate on later trades."""
    split = classifier.chrono_split(trades).cache()
    train, test = split.filter("part = 'train'"), split.filter("part = 'test'")
    model = classifier.fit_win_filter(train, trees=20)
    boosted = model.stages[-1]
    got = model.transform(test).collect()
    assert [r.ts for r in sorted(got, key=lambda r: r.ts)] == list(range(280, 400))
    for r in got:
        margin = sum(w * t.predict(r.features) for w, t in zip(boosted.treeWeights, boosted.trees))
        assert r.prediction == float(margin > 0)
        assert abs(r.probability[1] - 1 / (1 + math.exp(-2 * margin))) < 1e-9
    loss = lambda m: sum(-math.log(r.probability[int(r.result > 0)]) for r in m.transform(train).collect())
    assert loss(model) < loss(classifier.fit_win_filter(train, trees=2))
    rate = sum(r.result > 0 for r in got) / len(got)
    assert sum((r.prediction == 1) == (r.result > 0) for r in got) / len(got) > max(rate, 1 - rate) + 0.1


def test_report(trades):
    """Before and after by loop; a filter that takes nothing, and no trades at all."""
    tested = trades.withColumn("prediction", (F.col("atr") > 0.5).cast("double"))
    rows = tested.collect()
    for stage, own in (("before", rows), ("after", [r for r in rows if r.prediction == 1])):
        got = next(r for r in classifier.filter_report(tested).collect() if r.stage == stage)
        assert got.trades == len(own)
        assert abs(got.win_rate - 100 * sum(r.result > 0 for r in own) / len(own)) < 1e-9
        assert abs(got.net - sum(r.result for r in own)) < 1e-9
    none = {r.stage: (r.trades, r.win_rate, r.net) for r in classifier.filter_report(tested.withColumn("prediction", F.lit(0.0))).collect()}
    assert none["after"] == (0, 0.0, 0.0) and none["before"][0] == 400
    assert {(r.trades, r.win_rate, r.net) for r in classifier.filter_report(tested.limit(0)).collect()} == {(0, 0.0, 0.0)}


def test_too_few_trades(trades):
    assert {r.part for r in classifier.chrono_split(trades.filter("ts < 9")).collect()} == {None}

"""Longer contexts of PPM scores against plain loops, and what they gain."""

import inspect

import pytest
from pyspark.sql import functions as F

from tidemill.llm import ppm, queries

from .test_ppm import TEXTS, brute


@pytest.mark.parametrize("order", [4, 6])
def test_orders_match_loops(spark, order):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in ppm.ppm_scores(docs, F.col("doc_id") % 2 == 0, order=order, max_contexts=3, unit_bytes=40).collect()}
    want = brute([t or "" for t in TEXTS[::2]], [t or "" for t in TEXTS], order)
    assert got == {i: pytest.approx(s, rel=1e-4) for i, s in enumerate(want)}


def test_query_learns_long_contexts(spark, monkeypatch):
    own, seen = ppm.ppm_scores, []
    monkeypatch.setattr(ppm, "ppm_scores", lambda *a, **k: seen.append(inspect.signature(own).bind(*a, **k).arguments) or own(*a, **k))
    rows = queries.op8_ppm_scores(spark, "/root/testdata/sf0.001").collect()
    assert seen[0]["order"] == 6 and rows and all(r.score < 0 for r in rows)


def test_no_table_by_broadcast(spark, monkeypatch):
    def broadcast(*args):
        raise AssertionError("a table passes through the driver")

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    assert ppm.ppm_scores(docs, F.col("doc_id") % 2 == 0).count() == len(TEXTS)

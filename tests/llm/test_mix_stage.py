"""The mixing stage takes each source's target, whatever the ids are."""

from collections import Counter

import pytest

import corpus_pipeline
from tidemill.llm import mixing

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def made(kind):
    rows = []
    for source, n in (("a", 300), ("b", 300), ("c", 2_000)):
        for k in range(n):
            own = {"null": None, "shared": k, "repeated": k % 7, "one": 5}[kind] if source != "c" or kind != "null" else k
            rows.append((own, "w " * (20 + k * 37 % 60), "en", source, k))
    return rows


@pytest.mark.parametrize("kind", ["null", "shared", "repeated", "one"])
def test_targets_by_rows(spark, kind):
    rows = made(kind)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = corpus_pipeline.mix_stage(spark, docs, "").collect()
    size, taken = Counter(), Counter()
    for _, text, _, source, _ in rows:
        size[source] += len(text.split())
    for r in got:
        taken[r.source] += len(r.text.split())
    total = sum(size.values())
    target = {"a": total / 6, "b": total / 3, "c": total / 2}
    capped = {s: min(t, 3 * size[s]) for s, t in target.items()}
    assert capped == target
    assert all(abs(taken[s] - target[s]) <= 80 for s in target)
    have = Counter(rows)
    assert all(n <= 3 * have[r] for r, n in Counter(tuple(r) for r in got).items())


def test_equal_rows_share_their_copies(spark):
    rows = [(1, "one two three", "en", "a", 1)] * 40 + [(None, None, None, None, None)] * 5 + [(2, "x " * 30, "en", "b", 2)] * 3
    docs = spark.createDataFrame(rows, SCHEMA)
    got = Counter(tuple(r) for r in corpus_pipeline.mix_stage(spark, docs, "").collect())
    sums = Counter()
    for r in mixing.mix_sources(docs).collect():
        sums[r.doc_id] += r.copies
    assert {k[0]: n for k, n in got.items()} == {k: n for k, n in sums.items() if n}
    assert corpus_pipeline.mix_stage(spark, docs.limit(0), "").collect() == []


def test_large_units_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_RUN", 10)
    rows = [(1, "one two three", "en", "a", 1)] * 95 + [(k, "x y", "en", "b", k) for k in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = corpus_pipeline.mix_stage(spark, docs, "").collect()
    by = Counter(r.source for r in got)
    assert abs(3 * by["a"] - 405 / 3) <= 3 and abs(2 * by["b"] - 405 * 2 / 3) <= 2
    assert sum(r.copies for r in mixing.mix_sources(docs).collect()) == len(got)

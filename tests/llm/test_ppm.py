"""PPM scores and the unigram base against plain loops."""

import math
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import ppm
from tidemill.llm.ppm import ppm_scores

TEXTS = ["the cat sat on the mat", "The dog sat  on a log", "", None, "zebra über Öl", "aaaa aaaa aaaa", "the the\nthe " * 30, "q"]


def brute(train, texts, order=3):
    nodes = defaultdict(Counter)
    for t in train:
        b = [0xFE] * order + list(t.encode()) + [0xFF]
        for i in range(order, len(b)):
            for k in range(order + 1):
                nodes[tuple(b[i - k : i])][b[i]] += 1
    out = []
    for t in texts:
        b = [0xFE] * order + list(t.encode()) + [0xFF]
        total = 0.0
        for i in range(order, len(b)):
            p, gone = 1.0, set()
            for k in range(order, -1, -1):
                seen = nodes.get(tuple(b[i - k : i]))
                if seen is None:
                    continue
                left = {s: c for s, c in seen.items() if s not in gone}
                if not left:
                    continue
                n = sum(left.values()) + len(left)
                if b[i] in left:
                    total += math.log10(p * left[b[i]] / n)
                    break
                p *= len(left) / n
                gone |= set(seen)
            else:
                total += math.log10(p / (255 - len(gone)))
        out.append(total)
    return out


@pytest.mark.parametrize("limits", [{}, {"max_contexts": 7, "max_words": 3}])
def test_matches_loops(spark, limits):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "the cat", "y"), (0, TEXTS[0], "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = ppm_scores(docs, F.col("doc_id") % 2 == 0, **limits).collect()
    assert len(got) == len(rows)
    texts = [t or "" for _, t, _ in rows]
    train = [t or "" for i, t, _ in rows if i is not None and i % 2 == 0]
    low = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) + [None]
    counts = Counter(w for t in train for w in low(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for (i, _, _), t, s in zip(rows, texts, brute(train, texts)):
        words = low(t)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        want.append((i, len(words), sum(counts[w] > 0 for w in words), n, base, s))
    key = lambda r: (r[0] is None, r[0] or 0)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[:4] == b[:4]
        assert a[4] == pytest.approx(b[4], rel=1e-9)
        assert a[5] == pytest.approx(b[5], rel=1e-4)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "ab")], "doc_id bigint, text string")
    row = ppm_scores(docs, F.lit(False)).first()
    assert row.train_tokens == 0 and row.score == pytest.approx(-3 * math.log10(255), rel=1e-4)
    assert ppm_scores(docs.limit(0), F.lit(True)).count() == 0


def test_counting_holds_little_more_than_its_result():
    """Counts are those of one array, and taking in many parts needs at most three times the memory of the table that they make."""
    parts = [np.random.default_rng(k).integers(0, 1 << 40, 100_000) for k in range(40)]
    parts += [p[:50_000] for p in parts]
    counter = ppm._Counter()
    tracemalloc.start()
    for p in parts:
        counter.add(p)
    keys, n = counter.merged()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want, times = np.unique(np.concatenate(parts), return_counts=True)
    assert np.array_equal(keys, want) and np.array_equal(n, times)
    assert peak < 3 * (keys.nbytes + n.nbytes)

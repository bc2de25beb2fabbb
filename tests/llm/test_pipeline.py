"""The pipeline's stages against plain loops, one after another on their own inputs."""

import re
from collections import Counter, defaultdict

import corpus_pipeline as P
import public_tokenizers
import pytest
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in P.STAGES:
        docs.append(P.written(stage(spark, docs[-1], SF), "test"))
    return [[r.asDict() for r in d.collect()] for d in docs]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_filters_keep_columns(stages):
    for rows in stages[1:5]:
        assert set(rows[0]) == set(stages[0][0])
        known = {r["doc_id"]: r for r in stages[0]}
        assert all(r == known[r["doc_id"]] for r in rows)


def test_quality_drops_base_failures(stages):
    kept = {r["doc_id"] for r in stages[1]}
    for r in stages[0]:
        w = words(r["text"])
        seen = Counter(zip(w, w[1:], w[2:]))
        hit = set()
        for i, g in enumerate(zip(w, w[1:], w[2:])):
            if seen[g] > 1:
                hit |= {i, i + 1, i + 2}
        if len(w) < 50 or 100 * len(hit) > 50 * len(w):
            assert r["doc_id"] not in kept
    assert len(kept) > 0.5 * len(stages[0])


def test_exact(stages):
    best = defaultdict(int)
    for r in stages[1]:
        best[r["text"]] = max(best[r["text"]], r["doc_id"])
    assert sorted(best.values()) == sorted(r["doc_id"] for r in stages[2])


def test_near(stages):
    sets = {}
    for r in stages[2]:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), r["text"]))
        sets[r["doc_id"]] = {tuple(w)} if len(w) < 5 else set(zip(w, w[1:], w[2:], w[3:], w[4:]))
    low = {i: i for i in sets}
    while True:
        before = dict(low)
        for a in sets:
            for b in sets:
                if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
        if low == before:
            break
    assert sorted(set(low.values())) == sorted(r["doc_id"] for r in stages[3])


def test_mix(stages):
    sizes, taken = Counter(), Counter()
    for r in stages[3]:
        sizes[r["source"]] += len(words(r["text"]))
    for r in stages[4]:
        taken[r["source"]] += len(words(r["text"]))
    order = sorted(sizes)
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        left = (total - sum(capped.values())) / sum(w for s, w in weight.items() if s not in capped)
        more = {s: 3 * sizes[s] for s, w in weight.items() if s not in capped and w * left > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    for s in order:
        target = capped.get(s, weight[s] * left)
        longest = max(len(words(r["text"])) for r in stages[3] if r["source"] == s)
        assert abs(taken[s] - target) <= longest
    assert max(Counter(r["doc_id"] for r in stages[4]).values()) <= 3


def test_packing_is_a_round_trip(stages):
    import numpy as np

    t = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = Counter()
    for r in stages[4]:
        want[r["doc_id"], tuple(t.encode(r["text"], add_special_tokens=False).ids) + (0,)] += 1
    parts, room = defaultdict(list), defaultdict(list)
    for r in stages[5]:
        parts[r["doc_id"]].append((r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist())))
        room[r["sequence_id"]].append((r["offset"], r["length"]))
    for rows in room.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 1024
    for (doc, ids), n in want.items():
        got = Counter(parts[doc])
        assert all(got[a, ids[a : a + 1024]] == n for a in range(0, len(ids), 1024))
    assert sum(len(v) for v in parts.values()) == sum(n * -(-len(ids) // 1024) for (_, ids), n in want.items())

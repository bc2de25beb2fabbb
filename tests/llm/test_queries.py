"""The ten registered queries on the smallest tables, each against plain loops or its SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tidemill.llm import packing, pii, queries, toxicity
from tidemill.llm.token_counts import pre_tokens

from .test_edges import base_spans
from .test_html_text import brute_templates, html_text

SF, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    return queries.queries()[name](spark, SF).collect()


def test_op1(spark, docs):
    sets = {}
    for i, r in docs.items():
        w = WORD.findall(lower(r.text))
        sets[i] = ({tuple(w)} if len(w) < 4 else {tuple(w[k : k + 4]) for k in range(len(w) - 3)}) if w else set()
    low = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    for _ in range(20):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    got = {r.doc_id: r for r in rows(spark, "op1_ngram_jaccard_join")}
    degree = Counter(x for pair in links for x in pair)
    assert {i: (r.n_shingles, r.component_id, r.n_links) for i, r in got.items()} == {i: (len(s), low[i], degree[i]) for i, s in sets.items()}


def test_op2_equals_scalar_loop(spark, docs):
    """FTRL-proximal written out coordinate by coordinate."""
    s = toxicity.Settings()
    labels = [(r.doc_id, float(r.toxic)) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic is not None]
    features = {}
    for i, r in docs.items():
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        features[i] = [int(f) for f in toxicity._distinct(data, np.array([0, len(data)]), s.bits)] + [1 << s.bits]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    seen = [(np.array(features[i], np.int32), y) for i, y in labels if not held(i) and i in docs]
    seen.sort(key=lambda r: (len(r[0]), r[1], r[0].tobytes()))
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        l1 = 0.0 if k == 1 << s.bits else s.l1
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((s.beta + math.sqrt(n[k])) / s.alpha + s.l2)

    chance = lambda x: 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))
    for epoch in range(s.epochs):
        for j in np.random.Generator(np.random.PCG64([s.seed, epoch])).permutation(len(seen)).tolist():
            own = seen[j][0].tolist()
            w = {k: weight(k) for k in own}
            g = chance(sum(w.values())) - seen[j][1]
            for k in own:
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / s.alpha * w[k]
                n[k] += g * g
    got = {r.doc_id: r for r in rows(spark, "op2_toxicity")}
    assert set(got) == set(docs)
    for i, r in got.items():
        assert r.held_out == held(i) and r.predicted == int(r.score >= 0.3)
        assert r.score == pytest.approx(chance(sum(weight(k) for k in features[i])), abs=1e-4)


def test_op3_targets_and_balance(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}  # fifty documents a source
    run = lambda: queries.op3_mix_sources(spark, SF01).collect()
    size = {i: len(WORD.findall(r.text or "")) for i, r in docs.items()}
    per = Counter()
    for i, r in docs.items():
        per[r.source] += size[i]
    names = sorted(per, key=lambda x: (x is None, x or ""))
    weight = {x: k % 3 + 1 for k, x in enumerate(names)}
    target, free, left = {}, set(names), float(sum(per.values()))
    while free:
        unit = left / sum(weight[x] for x in free)
        over = {x for x in free if weight[x] * unit > 3 * per[x]}
        for x in over or free:
            target[x] = 3.0 * per[x] if over else weight[x] * unit
        left -= sum(target[x] for x in over)
        free = free - over if over else set()
    got = run()
    taken, number, total = Counter(), Counter(), Counter()
    for r in got:
        d = docs[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == per[d.source] and r.target == pytest.approx(target[d.source]) and 0 <= r.taken <= 3 * r["size"]
        taken[d.source] += r.taken
        if r["size"]:
            number[d.source] += r.taken / r["size"]
            total[d.source] += 1
    for x in names:
        assert abs(taken[x] - target[x]) <= max(2.0, 0.001 * target[x])
        assert abs(number[x] - total[x] * target[x] / max(per[x], 1)) <= 0.1 * total[x] + 5
    assert sorted(map(str, run())) == sorted(map(str, got))


@pytest.mark.parametrize("name", ["op4_quality_rules", "op7_exact_dedup"])
def test_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    rel = con.sql(queries.oracle_sql()[name])
    got = sorted(tuple(r[c] for c in rel.columns) for r in rows(spark, name))
    assert got == sorted(rel.fetchall())


def test_op5_first_fit_by_linear_scan(spark, docs):
    full = packing.tokenizer(PATH).full
    got, room = defaultdict(list), defaultdict(list)
    for r in rows(spark, "op5_pack_sequences"):
        got[r.doc_id].append(r)
        room[r.sequence_id].append((r.offset, r.length))
    for i, r in docs.items():
        ids = np.array([*full.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in sorted(got[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for v in room.values():
        assert [o for o, _ in sorted(v)] == [sum(n for _, n in sorted(v)[:k]) for k in range(len(v))] and sum(n for _, n in v) <= 1024
    groups = defaultdict(list)
    for own in got.values():
        for p in own:
            groups[p.sequence_id >> 32].append(p)
    for own in groups.values():
        free = []
        for n in sorted((p.length for p in own), reverse=True):
            fit = next((k for k, f in enumerate(free) if f >= n), None)
            if fit is None:
                free.append(1024 - n)
            else:
                free[fit] -= n
        used = Counter()
        for p in own:
            used[p.sequence_id] += p.length
        assert sorted(1024 - f for f in free) == sorted(used.values())
    lengths = np.array([random.Random(k).randint(1, 40) for k in range(300)])
    bins, offsets = packing.first_fit_decreasing(lengths, 64)
    free = []
    for k in np.argsort(-lengths, kind="stable").tolist():
        fit = next((b for b, f in enumerate(free) if f >= lengths[k]), len(free))
        free += [64] if fit == len(free) else []
        assert (bins[k], offsets[k]) == (fit, 64 - free[fit])
        free[fit] -= lengths[k]


def test_op6(spark, docs):
    for r in rows(spark, "op6_personal_data"):
        base = base_spans(docs[r.doc_id].text or "")
        kinds = Counter(pii.KINDS[k] for _, k, _ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in pii.KINDS)
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(filter(None, text.split(","))) <= set(spans)
        keys = [(int(s.split(":")[1]), pii.ALL.index(s.split(":")[0])) for s in spans]
        assert keys == sorted(keys)
        secrets = re.findall(r'token = "([0-9a-f]{40})"', (docs[r.doc_id].text or "").lower())
        assert sum(s.startswith("secret") for s in spans) == len(secrets)


def test_op8_base(spark, docs):
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    words = {i: [*WORD.findall(lower(r.text)), "\n"] for i, r in docs.items()}
    counts = Counter(w for i, own in words.items() if not held(i) for w in own)
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in rows(spark, "op8_ppm_scores")}
    for i, own in words.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(own), sum(counts[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), rel=1e-9)
        assert r.score < 0 and r.score > -4.2 * (len((docs[i].text or "").encode()) + 1)
    bits = -sum(got[i].score for i in docs if held(i)) / math.log10(2) / sum(len((docs[i].text or "").encode()) + 1 for i in docs if held(i))
    assert bits < 3.2


def test_op9(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    brute = brute_templates([(p.url, p.html or "") for p in pages])
    got = {r.page_id: r for r in rows(spark, "op9_main_text")}
    for p in pages:
        t = brute.get(re.match(r"https?://([^/]*)", p.url)[1])
        want = html_text._extract(p.html, t.root, t.static, t.drop) if t else html_text._extract(p.html, None, frozenset())
        assert (got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (want, len(want), p.url)


def test_op10(spark, docs):
    full, pre = packing.tokenizer(PATH).full, pre_tokens(PATH)
    for r in rows(spark, "op10_token_counts"):
        text = docs[r.doc_id].text or ""
        out, at, n = "", 0, 0
        for start, kind, end in sorted(base_spans(text), key=lambda s: (s[0], s[2])):
            if start >= at:
                out += text[at:start] + f"[{pii.KINDS[kind]}]"
                at, n = end, n + 1
        out += text[at:]
        count = lambda t: len(full.encode(t, add_special_tokens=False).ids)
        assert (r.n_chars, r.n_pretokens, r.n_tokens, r.n_edits, r.n_tokens_after) == (len(text), len(pre.split(text)), count(text), n, count(out))
        assert (r.n_reencoded > 0) == (n > 0) and r.n_reencoded <= 40 * n


def test_pipeline_leaves_only_its_last_input(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(folder.iterdir())
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [p.name.rsplit("-", 1)[0] for p in folder.iterdir() if p not in before] == ["tidemill-mixing"]


def test_mixing_of_ties(spark):
    from tidemill.llm import mixing

    df = spark.createDataFrame([(None, "one two three", "a")] * 500 + [(i, "w " * (i % 7 + 1), "b") for i in range(300)], "doc_id bigint, text string, source string").repartition(3)
    got = mixing.mix_sources(df, group_rows=50).collect()
    assert len(got) == 800
    for source in ("a", "b"):
        own = [r for r in got if r.source == source]
        assert abs(sum(r["size"] * r.copies for r in own) - own[0].target) <= 8
        assert max(r.copies for r in own) - min(r.copies for r in own) <= 1

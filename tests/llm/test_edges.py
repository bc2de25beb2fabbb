"""Every operator on nulls, empty and long texts, repeated rows, ties, empty tables and columns with clashing names."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemill.llm import exact_dedup, html_text, jaccard, mixing, packing, pii, ppm, quality, token_counts, toxicity

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen"
TEXTS = [
    BASE, BASE.upper(), BASE + " end", None, "", "   \n\t ", "one two", "One two", "one", LONG, LONG + " tail", "é ü ß " * 40,
    "a@b.com call +1 (956) 555-0122 or 10.0.0.1, 4111 1111 1111 1111", "x\n" * 30, "!" * 500, "の漢字 " * 20,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", ["b", None, "a"][i % 3], 1, 2, 3, 4.0, "k") for i, t in enumerate(TEXTS)]
    rows += [(0, TEXTS[0], "en", "b", 1, 2, 3, 4.0, "k"), (None, BASE, None, None, None, 2, 3, 4.0, None), (None, None, None, None, None, 2, 3, 4.0, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, _id int, size int, score double, kept string").repartition(3)


def all_rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def run_all(docs, labels):
    return {
        "jaccard": jaccard.ngram_jaccard_join(docs, k=4, num=85),
        "toxicity": toxicity.toxicity(docs, labels, settings=toxicity.Settings(bits=12)),
        "mixing": mixing.mix_sources(docs),
        "quality": quality.quality_rules(docs),
        "packing": packing.pack_documents(docs, PATH),
        "pii": pii.personal_data(docs),
        "dedup": exact_dedup.exact_duplicates(docs),
        "ppm": ppm.ppm_scores(docs, F.col("doc_id") % 2 == 0),
        "tokens": token_counts.edited_token_counts(docs, PATH),
    }


@pytest.fixture(scope="module")
def results(spark, docs):
    labels = spark.createDataFrame([(i, 1, int(i % 2)) for i in range(0, 16)] + [(3, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    return {k: df.collect() for k, df in run_all(docs, labels).items()}


def test_a_row_per_row(docs, results):
    want = Counter(i for i, _ in all_rows(docs))
    for name, rows in results.items():
        if name != "packing":
            assert Counter(r.doc_id for r in rows) == want, name


def test_empty_table(spark, docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for name, df in run_all(docs.limit(0), labels).items():
        assert df.count() == 0, name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0, name


def test_stages_take_odd_rows(spark, docs):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name


def test_jaccard(docs, results):
    sets = {}
    for i, t in all_rows(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if i is not None:
            sets[i] = ({tuple(w)} if len(w) < 4 else {tuple(w[k : k + 4]) for k in range(len(w) - 3)}) if w else set()
    low = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    for r in results["jaccard"]:
        if r.doc_id is None:
            assert r.component_id is None and r.n_links == 0
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), low[r.doc_id])
    assert {r.n_links for r in results["jaccard"] if r.doc_id == 9} == {1}


def test_jaccard_tiles_and_joins(docs, results):
    got = jaccard.ngram_jaccard_join(docs, k=4, num=85, tile_rows=1, broadcast_rows=0).collect()
    assert sorted(map(str, got)) == sorted(map(str, results["jaccard"]))


def test_jaccard_without_link_counts(docs, results):
    for rows in (1, 512):
        got = jaccard.ngram_jaccard_join(docs, k=4, num=85, tile_rows=rows, links=False).collect()
        key = lambda r: str((r.doc_id, r.n_shingles, r.component_id))
        assert sorted(map(key, got)) == sorted(map(key, results["jaccard"]))


def test_fewer_pairs_connect_the_same():
    import numpy as np

    rng = np.random.default_rng(6)
    base = [np.sort(rng.choice(2**60, 60, False)).astype(np.uint64) for _ in range(6)]
    sets = [np.sort(np.append(rng.choice(base[i % 6], 57, False), rng.integers(2**61, 2**62, 3).astype(np.uint64))) for i in range(80)]
    n = np.array([len(x) for x in sets])
    a, b = np.triu_indices(80, 1)
    same = jaccard._overlaps(sets, a, b)
    hit = 100 * same >= 80 * (n[a] + n[b] - same)
    parts = [{frozenset(x) for x in _groups(80, p)} for p in (list(zip(a[hit], b[hit])), list(zip(*jaccard._linking(sets, n, a, b, 80, 100))))]
    assert parts[0] == parts[1]


def _groups(n, pairs):
    low = list(range(n))
    for _ in range(n):
        for x, y in pairs:
            low[x] = low[y] = min(low[x], low[y])
    return [[i for i in range(n) if low[i] == k] for k in set(low)]


def test_near_copies_by_the_hundred(spark):
    words = [f"t{i}" for i in range(120)]
    rows = [(i, " ".join(words[:i] + ["edit"] + words[i + 1 :])) for i in range(120)] + [(1000 + i, " ".join(words)) for i in range(50)]
    got = jaccard.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string"), tile_rows=40).collect()
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t in rows}
    links = Counter()
    for a, _ in rows:
        for b, _ in rows:
            links[a] += a != b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert {r.doc_id: r.n_links for r in got} == dict(links)
    assert {r.component_id for r in got} == {0}


def test_dedup(docs, results):
    groups = defaultdict(list)
    for i, t in all_rows(docs):
        groups[t or ""].append(i)
    for r in results["dedup"]:
        ids = next(v for t, v in groups.items() if r.text_sha256 == hashlib.sha256(t.encode()).hexdigest() and r.doc_id in v)
        best = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (best, len(ids), r.doc_id == best)
    kept = exact_dedup.drop_duplicates(docs).collect()
    assert sorted(r.text or "" for r in kept) == sorted(groups)
    by_join = exact_dedup.exact_duplicates(docs, broadcast_rows=0).collect()
    assert sorted(map(str, by_join)) == sorted(map(str, results["dedup"]))


def test_filters_merge_without_loss():
    import numpy as np

    rng = np.random.default_rng(3)
    for bits in (1, 9, 17, 40):
        parts = [rng.integers(0, 2**bits * 300, rng.integers(0, 600), dtype=np.uint64) // np.uint64(300) for _ in range(4)] + [np.zeros(70_000, np.uint64)]
        blocks = []
        for k, p in enumerate(parts):
            values, counts = np.unique(p, return_counts=True)
            q = min(k, bits)
            blocks.append(exact_dedup.CountingQuotientFilter(q, bits - q).pack(values, counts))
            again = exact_dedup.CountingQuotientFilter.unpack(blocks[-1])
            assert again[0].tolist() == values.tolist() and again[1].tolist() == counts.tolist()
        got = exact_dedup.CountingQuotientFilter.merge(blocks)
        assert dict(zip(*(x.tolist() for x in got))) == Counter(np.concatenate(parts).tolist())


def test_filters_are_small(spark):
    import numpy as np

    values = np.unique(np.random.default_rng(1).integers(0, 2**33, 100_000, dtype=np.uint64))
    q = len(values).bit_length()
    assert len(exact_dedup.CountingQuotientFilter(q, 33 - q).pack(values, np.ones(len(values), np.int64))) < 2.6 * len(values)
    df = spark.createDataFrame([(i % 2000, ) for i in range(3000)], "p bigint").repartition(5)
    assert sorted(r.p for r in exact_dedup.repeated_fingerprints(df, "p", 3000, 28, per_slice=50).collect()) == list(range(1000))


def test_dedup_hot_groups_and_unique_rows_without_shuffle(spark):
    rows = [(i, "the same") for i in range(400)] + [(1000 + i, f"pair {i // 2}") for i in range(100)] + [(2000 + i, f"own {i}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = {i: (max(j for j, u in rows if u == t), sum(u == t for _, u in rows)) for i, t in rows}
    for hot, few in ((50, 2_000_000), (10**9, 2_000_000), (1, 0)):
        got = exact_dedup.exact_duplicates(df, broadcast_rows=few, hot_rows=hot)
        assert {r.doc_id: (r.keep_id, r.group_size) for r in got.collect()} == want and all(r.kept == (r.doc_id == r.keep_id) for r in got.collect())


def test_quality_counts(results):
    by = {r.doc_id: r for r in results["quality"] if r.doc_id is not None}
    assert (by[13].n_words, by[13].n_dup_lines, by[13].n_repeat_words) == (30, 29, 30)
    assert by[4].n_words == 0 and by[4].base_failed and not by[4].kept
    assert by[12].word_chars == len("".join(TEXTS[12].split()))


def test_mixing_is_near_and_repeats(docs, results):
    again = mixing.mix_sources(docs, group_rows=2).collect()
    for rows in (results["mixing"], again):
        taken, target = Counter(), {}
        for r in rows:
            taken[r.source] += r["size"] * r.copies
            target[r.source] = r.target
            assert r["size"] * r.copies <= 3 * r["size"]
        assert all(abs(taken[s] - target[s]) <= 60_001 for s in target)
    assert sorted(map(str, mixing.mix_sources(docs).collect())) == sorted(map(str, results["mixing"]))


def test_targets_cap_and_reshare(spark):
    sizes = spark.createDataFrame([("a", 900), ("b", 50), ("c", 50), (None, 0)], "source string, size bigint")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["b"] == 150 and got["c"] == 150 and got[None] == 0 and abs(got["a"] - 700) < 1e-9


def test_packing_whole(docs, results):
    full = packing.tokenizer(PATH).full
    room = defaultdict(list)
    for r in results["packing"]:
        assert r.length == len(r.ids) // 4 <= 1024
        room[r.sequence_id].append((r.offset, r.length))
    for v in room.values():
        assert [o for o, _ in sorted(v)] == [sum(n for _, n in sorted(v)[:k]) for k in range(len(v))] and sum(n for _, n in v) <= 1024
    assert sum(r.length for r in results["packing"]) == sum(len(full.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in all_rows(docs))


def test_tokenizer_equals_the_library():
    t = packing.tokenizer(PATH)
    spread = " ".join(f"w{i % 977}!\x1c  {i}\n" for i in range(90_000))
    for s in [" " * 1_000_000, "a" + "\u3000" * 200_000 + " b", spread, *[x or "" for x in TEXTS[:9]], "<|endoftext|> a", "a\x85b　 ​ c", "I'LL it's"]:
        assert t.ids(s).tolist() == t.full.encode(s, add_special_tokens=False).ids


def test_packing_long_white_space_and_hot_ids(spark):
    rows = [(1, " " * 1_000_000), (2, "x")] + [(None, "same words")] * 300 + [(7, f"text {i}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    got = packing.pack_documents(df, PATH, group_documents=50).collect()
    full = packing.tokenizer(PATH).full
    assert sum(r.length for r in got) == sum(len(full.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)
    of = lambda i: Counter(r.sequence_id >> 32 for r in got if r.doc_id == i)
    assert len(of(7)) >= 8 and max(of(7).values()) < 80 and len(of(None)) >= 8 and max(of(None).values()) < 80


def test_personal_data_kinds(spark):
    """Planted spans of every added kind are found, what looks like them is left alone."""
    import random

    rng = random.Random(5)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    bad = ["commit {h}", "sha1 {h}", "order 123-45-67890", "number 000-12-3456", "Mr smith", "version 1.2.3", "DE00 1234 5678 9012 3456 78 is no account", "plain text of {i} words", "the long_identifier_of_some_function_name_here", "in 2024-2025 and 300-400"]
    good = ['token = "{h}"', "IBAN DE89 3704 0044 0532 0130 00 please", "my ssn 123-45-{d}", "ask for Dr. Maria Lopez today", "mail jane{i} [at] home (dot) org now", "call 415-555-{d} soon", "card 4111 1111 1111 1112 visa"]
    rows = [(k, "some words before " + rng.choice(good[:6]).format(h=hexes(40), i=k, d=rng.randint(1000, 9999)) + " and after", 1) for k in range(300)]
    rows += [(1000 + k, "some words before " + rng.choice(bad).format(h=hexes(40), i=k) + " and after", 0) for k in range(300)]
    rows += [(2000 + k, f"write to a{k}@b.com or +1 (415) 555-{k + 1000}", 1) for k in range(100)]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string, y int")).collect()}
    hit = [bool(got[i]) for i, _, y in rows if y]
    false = [rows[k][1] for k in range(len(rows)) if not rows[k][2] and got[rows[k][0]]]
    assert sum(hit) >= 0.95 * len(hit), [t for i, t, y in rows if y and not got[i]][:5]
    assert len(false) <= 0.02 * 300, false[:5]
    for i, text, _ in rows:
        assert all(text[s.start : s.end] == s.text for s in got[i])


def test_personal_data_many_hits(spark):
    import time

    text = " ".join(f"user{i}@mail.example.com" for i in range(100_000)) + " jane [at] home.org"
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    start = time.perf_counter()
    spans = pii.personal_data(df).collect()[0].spans
    assert time.perf_counter() - start < 60
    found = [(m.start(), m.end()) for m in EMAIL.finditer(text)]
    assert [(s.start, s.end) for s in spans if s.base] == found and len(spans) == len(found) + 1


EMAIL, IP, CARD, PHONE = (re.compile(p, re.A) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def base_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(sum(divmod(2 * int(x), 10)) if k % 2 else int(x) for k, x in enumerate(reversed(d))) % 10 == 0

    out = [("email", m) for m in EMAIL.finditer(t)]
    out += [("ip", m) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m) for m in CARD.finditer(t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", m) for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]
    return sorted((m.start(), pii.KINDS.index(k), m.end()) for k, m in out)


def test_personal_data_base(spark):
    import random

    rng = random.Random(9)
    bits = ["a@b.co", "x_y@", "@", ".", "-", " ", "1.2.3.4", "999.1.2.3", "1.2.3.4.5.6.7.8", "4111111111111111", "4111 1111-1111 1111", "12--34", "+1 (956) 555-0122", "+49", "((", "q", "7", "😀é", "\n", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(600)] + ["9" * 100_000, "a" * 50_000 + "@", "+" + "(" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in pii.personal_data(df).collect():
        got = [(s.start, pii.KINDS.index(s.kind), s.end) for s in r.spans if s.base]
        assert got == base_spans(texts[r.doc_id]), texts[r.doc_id][:200]


def test_personal_data_adds_and_spares(spark):
    rows = [(i, f"please write to mail jane.doe{i} [at] mail dot [dot] org now") for i in range(5)]
    rows += [(100 + i, f"mail: jane{i} (at) home (dot) org thanks") for i in range(40)] + [(200 + i, f"plain words with number {i} {i * 7}") for i in range(40)]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(len(got[100 + i]) == 1 and not got[100 + i][0].base for i in range(40))
    assert all(not got[200 + i] for i in range(40))


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    own = [r for r in rows if r.held_out]
    bad, good = [r for r in own if r.toxic], [r for r in own if not r.toxic]
    assert sum(r.predicted for r in bad) >= 0.8 * len(bad) and sum(r.predicted for r in good) <= 0.01 * len(good)
    assert sum(a.score > b.score for a in bad for b in good) >= 0.97 * len(bad) * len(good)


def test_html(spark):
    page = "<html><head><title>t</title><style>p{}</style></head><body><nav><a>menu</a></nav><div class='ad'>buy</div>%s<footer>&copy; x</footer></body></html>"
    rows = [(i, f"http://h{i % 2}.example/{i}", page % f"<article><h1>Head {i}</h1><p>Text &amp; {i}<br>more  words</p><script>x</script><form>f</form><div class='comments'><p>no</p></div></article>") for i in range(6)]
    plain = "<body><div>site name</div><p>story %d</p><div>site end</div></body>"
    rows += [(10 + i, f"https://plain.example/{i}", plain % i) for i in range(5)] + [(20, None, None), (21, "x", ""), (22, "http://one.example", "just text <b>bold"), (None, "http://h0.example/", page % "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1))
    got = {r.page_id: r for r in html_text.main_text(df).collect()}
    assert all(got[i].text == f"Head {i}\nText & {i} more words" and got[i].n_chars == len(got[i].text) for i in range(6))
    assert all(got[10 + i].text == f"story {i}" for i in range(5))
    assert got[20].text == "" and got[21].text == "" and got[22].text == "just text bold" and None in got
    joined = html_text.main_text(df, broadcast_mb=-1)
    assert {r.page_id: r.text for r in joined.collect()} == {k: r.text for k, r in got.items()}
    assert html_text.main_text(df.limit(0)).count() == 0

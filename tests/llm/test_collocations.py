"""Collocations against plain loops."""

import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest

from tidemill.llm import collocations, queries
from tidemill.llm.collocations import phrase_counts, shards


def pieces_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute_counts(rows, longest=4):
    f = Counter()
    for lang, text in rows:
        for w in pieces_of(text):
            for m in range(1, longest + 1):
                f.update((lang or "und", " ".join(w[i : i + m])) for i in range(len(w) - m + 1))
    return f


def brute(rows, support, keep=2_000):
    f = brute_counts(rows)
    n = Counter()
    for (lang, p), c in f.items():
        n[lang] += c * (p.count(" ") == 0)
    cands = {k: c for k, c in f.items() if " " in k[1] and c >= support}
    longer = Counter()
    for (lang, p), c in cands.items():
        w = p.split(" ")
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                key = (lang, " ".join(w[i : i + m]))
                longer[key] = max(longer[key], c)
    out = []
    for (lang, p), a in cands.items():
        if 100 * longer[lang, p] >= 80 * a:
            continue
        w = p.split(" ")
        cuts = [(2_000_000 * a // (f[lang, " ".join(w[:k])] + f[lang, " ".join(w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, -score, -a, p.encode(), f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]))
    result, rank = [], Counter()
    for lang, s, a, p, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= keep:
            result.append((lang, rank[lang], p.decode(), -a, left, right, n[lang], -s))
    return sorted(result)


def made(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)] + ["É", "the", "The", "of", "a-b", "日本", "#1"]
    fixed = ["new york city hall", "new york", "in spite of", "The The The"]
    word = lambda: rng.choice(fixed) if rng.random() < 0.3 else rng.choice(vocab)
    sep = lambda: rng.choice([" "] * 8 + ["\t", "  ", ", ", ".", "\n", "!\r\n", "\x0b", ": "])
    return [(rng.choice(["en", "EN", None, "und", "de"]), "".join(word() + sep() for _ in range(rng.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("seed,support,shard,bits", [(1, 3, 1 << 24, 1 << 20), (2, 5, 300, 1 << 15), (3, 30, 200, 1 << 20), (4, 2, 64, 1 << 15)])
def test_matches_loops(spark, seed, support, shard, bits):
    rows = made(seed) + [("en", None), (None, ""), ("en", " . , "), ("en", "a")]
    rows += rows[:7]
    df = spark.createDataFrame([(*r, 1, "k", 2.0) for r in rows], "lang string, text string, n int, phrase string, score double").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(df, support, shard_bytes=shard, filter_bits=bits, section_words=400, keep=40).collect())
    assert got == brute(rows, support, 40) and got


def test_long_texts_are_cut_without_loss(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdef") for _ in range(3_000)), "x" * 5_000 + " y z " + "q" * 3_000, ("ab cd ef gh ij. " * 400), "one two three\tfour " * 50 + "\n" * 900 + "five six"]
    for most in (7, 50, 333, 4_096):
        batch = pa.RecordBatch.from_arrays([pa.array(["x"] * len(texts)), pa.array(texts)], names=["lang", "text"])
        got = Counter()
        for shard in shards(iter([batch]), most):
            for m in (1, 2, 3, 4):
                got.update(("x", shard.text(k, m)) for k in shard.phrases(m)[0].tolist())
        assert got == brute_counts([("x", t) for t in texts])


def test_shards_prune(spark):
    """A phrase that no shard has its part of isn't counted; one that is frequent in the whole is, however it is spread."""
    rows = [("x", f"p{k % 40} q{k % 40}. u{k} v{k}. u{k} v{k}") for k in range(1_000)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    counts, totals = phrase_counts(df, 25, shard_bytes=4_000)
    assert {r.phrase for r in counts.filter("words = 2").collect()} == {f"p{k} q{k}" for k in range(40)}
    assert [tuple(r) for r in totals.collect()] == [("x", 6_000)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(df).collect() == []


def test_exact_beyond_64_bits(spark, monkeypatch):
    a = 9 * 10**17
    rows = [("x", 1, "p", a), ("x", 1, "q", a + 1), ("x", 2, "p q", a - 1)]
    counts = spark.createDataFrame(rows, "lang string, words int, phrase string, f bigint")
    monkeypatch.setattr(collocations, "phrase_counts", lambda *args, **kw: (counts, counts.groupBy("lang").agg({"f": "max"}).withColumnRenamed("max(f)", "n")))
    got = collocations.collocations(counts).first()
    assert (got.score, got.l, got.r) == (2_000_000 * (a - 1) // (2 * a + 1), a, a + 1)


def test_registered_query(spark):
    sf = "/root/testdata/sf0.01"
    spark_rows = sorted(tuple(r) for r in queries.op13_collocations(spark, sf).collect())
    docs = [(r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert spark_rows == brute(docs, 30)
    path = Path(sf, "documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path / '*.parquet' if path.is_dir() else path}'")
    assert sorted(con.execute(queries.oracle_sql()["op13_collocations"]).fetchall()) == spark_rows

"""Edited counts equal those of encoding the edited text anew."""

import random
import time

import public_tokenizers
from pyspark.sql import functions as F

from tidemill.llm.packing import tokenizer
from tidemill.llm.token_counts import SegmentTree, apply_edits, edited_token_counts, pre_tokens

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def test_random_edits():
    pre, full = pre_tokens(PATH), tokenizer(PATH).full
    rng = random.Random(4)
    pool = ["the", " cat", "'s", "'re", "'", "  ", "\n", "\t ", "12", "é", "!?", " .", "x" * 9, "　", "don't", "<|endoftext|>"]
    for n in [0, 1, 3, 20, 400] * 30:
        text = "".join(rng.choice(pool[:-1] if rng.random() < 0.97 else pool) for _ in range(n))
        parts = pre.split(text)
        tree = SegmentTree(list(map(len, parts)), pre.number(parts))
        cuts = sorted(rng.randint(0, len(text)) for _ in range(2 * rng.randint(1, 5)))
        edits = [(a, b, "".join(rng.choice(pool[:-1]) for _ in range(rng.randint(0, 3)))) for a, b in zip(cuts[::2], cuts[1::2])]
        want, at = "", 0
        for a, b, new in edits:
            want += text[at:a] + new
            at = b
        want += text[at:]
        got, _ = apply_edits(text, tree, edits, pre)
        fresh = pre.split(want)
        assert got == want
        assert [x for leaf, _ in tree.leaves for x in leaf] == list(map(len, fresh))
        assert tree.total == (len(want), len(full.encode(want, add_special_tokens=False).ids), len(fresh))


def test_few_encoded_again():
    pre = pre_tokens(PATH)
    text = "some plain words here. " * 2000
    parts = pre.split(text)
    tree = SegmentTree(list(map(len, parts)), pre.number(parts))
    assert apply_edits(text, tree, [(20000, 20005, "other")], pre)[1] < 10


def test_query_shape(spark):
    rows = [(1, "call me at home", [(5, 7, "you"), (6, 9, "no"), (11, 99, "!")]), (None, None, None), (2, "", []), (2, "", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, edits array<struct<start:int,end:int,text:string>>")
    got = {(r.doc_id, r.n_chars): r for r in edited_token_counts(docs, PATH, edits_col="edits", keep=True).collect()}
    assert got[1, 15].text_after == "call you at !" and got[1, 15].n_edits == 2
    assert got[1, 15].n_tokens_after == len(tokenizer(PATH).full.encode("call you at !", add_special_tokens=False).ids)
    assert got[None, 0].n_tokens == 0 and got[2, 0].n_edits == 0
    assert edited_token_counts(docs.limit(0), PATH).count() == 0


def test_counts_match_whole_encoding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.n_tokens for r in edited_token_counts(docs, PATH).collect()}
    full = tokenizer(PATH).full
    for r in docs.collect():
        assert got[r.doc_id] == len(full.encode(r.text or "", add_special_tokens=False).ids)


def test_kept_trees_are_used_again(spark):
    text = "some plain words here. " * 500
    rows = [(i, text, [(4000 + i, 4005 + i, "other")]) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, edits array<struct<start:int,end:int,text:string>>")
    first = edited_token_counts(docs, PATH, edits_col="edits", keep=True)
    again = first.select("doc_id", F.col("text_after").alias("text"), "tree", F.expr("array(named_struct('start', 900, 'end', 901, 'text', 'new'), named_struct('start', 5000, 'end', 5000, 'text', ' !'))").alias("edits"))
    full = tokenizer(PATH).full
    for r in edited_token_counts(again, PATH, edits_col="edits", keep=True, tree_col="tree").collect():
        assert r.n_edits == 2 and 0 < r.n_reencoded < 20
        assert r.n_tokens_after == len(full.encode(r.text_after, add_special_tokens=False).ids)
    pre = pre_tokens(PATH)  # with a tree nothing but the edit's surroundings is split or encoded
    tree = SegmentTree.read(SegmentTree(*pre.measure(text)).packed())
    pre.counts.clear()
    assert apply_edits(text, tree, [(4000, 4005, "zebra")], pre)[1] < 10 and len(pre.counts) < 10
    stale = docs.select("doc_id", "text", F.lit(b"\0\0\0\0").alias("tree"))
    assert {r.n_tokens for r in edited_token_counts(stale, PATH, tree_col="tree").collect()} == {len(full.encode(text, add_special_tokens=False).ids)}


def test_leaves_are_split():
    pre = pre_tokens(PATH)
    text = "one two three"
    tree = SegmentTree(*pre.measure(text))
    apply_edits(text, tree, [(3, 3, " more words" * 500)], pre)
    assert len(tree.leaves) > 10 and max(len(x) for x, _ in tree.leaves) <= 64


def test_many_edits_and_long_white_space():
    pre, full = pre_tokens(PATH), tokenizer(PATH).full
    text = "a few words and so on, " * 50_000
    edits = [(11 * i + 3, 11 * i + 5, "q") for i in range(100_000)]
    start = time.perf_counter()
    tree = SegmentTree(*pre.measure(text))
    got, _ = apply_edits(text, tree, edits, pre)
    assert time.perf_counter() - start < 60
    assert tree.total == (len(got), len(full.encode(got, add_special_tokens=False).ids), len(pre.split(got)))
    spaces = "a" + " " * 1_000_000 + "b"
    assert int(pre.measure(spaces)[1].sum()) == len(full.encode(spaces, add_special_tokens=False).ids)

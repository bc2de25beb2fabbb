"""Leaders of large blocks and classes leave the result of the join as it is."""

import random

from tidemill.llm import jaccard


def near_copies(seed):
    """Families of near copies, of which some link only by way of others, among texts that share a passage."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for family, size in enumerate((60, 25, 9)):
        base = rng.choices(words, k=90)
        for _ in range(size):
            text = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 3))):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append(text)
            if rng.random() < 0.2:
                rows.append(text)
    passage = rng.choices(words, k=30)
    rows += [passage + rng.choices(words, k=40) for _ in range(20)]
    rng.shuffle(rows)
    return [(i * 3 + 1, " ".join(t)) for i, t in enumerate(rows)]


def brute_force(rows, k, num):
    sets = {i: {tuple(t.split()[a : a + k]) for a in range(len(t.split()) - k + 1)} for i, t in rows}
    low, links, ids = {i: i for i in sets}, dict.fromkeys(sets, 0), sorted(sets)
    pairs = [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return {i: (len(sets[i]), low[i], links[i]) for i in sets}


def test_leaders_against_all_pairs(spark):
    for seed in (1, 2):
        rows = near_copies(seed)
        docs, expected = spark.createDataFrame(rows, "doc_id bigint, text string"), brute_force(rows, 5, 80)
        for tile_rows, broadcast_rows in ((4, 500_000), (16, 0)):
            got = jaccard.ngram_jaccard_join(docs, tile_rows=tile_rows, broadcast_rows=broadcast_rows, links=False).collect()
            assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: x[:2] for i, x in expected.items()}
        got = jaccard.ngram_jaccard_join(docs, tile_rows=8).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == expected


def test_followers_meet_only_others(spark):
    """A class whose rows all link with its leader needs no pairs of tiles; each row is compared once."""
    base = [f"v{i}" for i in range(200)]
    rows = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(40)]
    docs = spark.createDataFrame(rows, "id bigint, text string")
    members = docs.selectExpr("7L as component", "id", "1L as copies")
    followers = jaccard._followers(members, docs, jaccard._near_leader(80, 100, 5), 8, lambda df: df)
    assert sorted((r.leader, r.id) for r in followers.collect()) == [(0, i) for i in range(40)]
    assert jaccard._tiles(members, 8, followers).count() == 0
    one_left = followers.filter("id <> 39")
    met = jaccard._tiles(members, 8, one_left)
    assert met.filter("id = 39").count() == met.select("i", "j").distinct().count() == 1 + met.select("j").distinct().count() - 1
    assert met.filter("id <> 39").groupBy("id").count().filter("count > 1").count() == 0
    assert jaccard._followers(members, docs, jaccard._near_leader(80, 100, 5), 40, lambda df: df) is None

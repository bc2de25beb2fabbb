"""Conversation repair against a search of all edits, and what its tree holds."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import pytest

from tidemill.llm import queries, repair

WHITE = re.compile(r"[^\x20\x09-\x0D]")


def cheapest(rows, slack=1):
    """(cost, audit, repaired) of the cheapest edits of (role, text, fault) rows, ASCII-least: a recursion over all edits, from the last row back."""
    legal = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @cache
    def rest(k, state, inserts):
        out = [(0, "", ())] if k == len(rows) and state in ("", "a") else []
        made = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
        add = lambda cost, letter, line, tails: [(cost + c, letter + a, (*line, *t)) for c, a, t in tails]
        if inserts:
            out += add(5, "I", [f"{made}:"], rest(k, made[0], inserts - 1))
        if k < len(rows):
            role, text, why = rows[k]
            out += add(2, "D", [], rest(k + 1, state, slack + 1))
            late = 5 if why == "truncated" else 0
            if why not in ("blank", "duplicate"):
                if role[:1] in legal[state]:
                    out += add(late, "K", [f"{role}:{text}"], rest(k + 1, role[:1], slack + 1))
                out += add(1 + late, "R", [f"{made}:{text}"], rest(k + 1, made[0], slack + 1))
        return tuple(sorted(set(out))[:1]) if len(out) else ()

    return rest(0, "", slack + 1)[0]


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = WHITE.findall(text)
        why = "blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, why))
    return out


def walked(rows):
    r = repair.Repair()
    nodes = [n for row in rows for n in r.push(row)] + r.end()
    lines = [f"{n.role}:{n.row[1] if n.row else ''}" for n in nodes if n.edit != "D"]
    return sum(n.cost for n in nodes), "".join(n.edit for n in nodes), tuple(lines)


@pytest.mark.parametrize("seed", range(40))
def test_cheapest_edits(seed):
    rng = random.Random(seed)
    for _ in range(25):
        rows = faults([(rng.choice(["user", "assistant", "system", "tool", "", " ", "u2"]), rng.choice(["a.", "b!", "c", " ", "", "d?", "e "])) for _ in range(rng.randint(0, 8))])
        assert walked(rows) == cheapest(tuple(rows))


def test_only_differing_edits_are_held():
    r, held = repair.Repair(), []

    def size(n):
        return 1 + sum(map(size, n.kids))

    for k in range(3_000):
        r.push((("user", "assistant")[k % 2] if k % 7 else "tool", f"{k}.", None))
        held.append(size(r.root))
    assert max(held) < 40


def test_long_tie_is_compared_whole():
    rows = [("assistant", f"{k}.", None) for k in range(2_001)]
    cost, audit, _ = walked(rows)
    assert (cost, audit[:3], len(audit)) == (1_002, "DRK", 2_001)


def brute(rows):
    """All columns of the contract by loops from (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    text_of = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        role, text, own = text_of(role), text_of(text), convs[conv]
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort()
        turns = [t for known, t, *_ in own if known]
        found = faults([x[2:] for x in own])
        count = lambda w: sum(f[2] == w for f in found)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = cheapest(tuple(found))
        gaps = turns[-1] - turns[0] + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_registered_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in queries.op12_conversation_repair(spark, sf).collect()}
    assert got == brute(rows) and len(got) > 90


def test_edge_cases(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, 0, 1, 2, 5, 5]), rng.choice([None, "user", "assistant", "system", ""]), rng.choice([None, "", "a.", "b", "ü\u0085", "x" * 50_000 + "."])) for _ in range(300)]
    rows += rows[:20]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, edit string, place int")
    out = repair.audits(repair.repair_conversations(repair.damaged(df)))
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == brute(rows)
    assert repair.audits(repair.repair_conversations(repair.damaged(df.limit(0)))).collect() == []


def test_edits_are_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "tool", "Yes."), (1, 2, "user", "And?"), (2, 0, "assistant", "")], "conv_id int, turn int, role string, text string")
    got = [tuple(r) for r in repair.repair_conversations(df).orderBy("conv_id", "place").select("conv_id", "place", "edit", "role", "text", "fault").collect()]
    assert got == [(1, 0, "K", "user", "Hi.", None), (1, 1, "D", None, None, None), (1, 2, "R", "assistant", "And?", None), (2, 0, "D", None, None, "blank")]

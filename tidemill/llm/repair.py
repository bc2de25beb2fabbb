"""Conversation structure repair: the cheapest edits that give alternating turns, by Viterbi with survivor coalescence.

A repaired conversation is empty, or an optional first turn ``s`` followed by pairs ``u``, ``a`` (first letters of
roles). Four states say what may come next. Per row every state has one survivor, the cheapest edits that lead to it,
the ASCII-least of equally cheap ones. Survivors are leaves of a tree of backpointers whose nodes count what refers to
them: a branch without survivors goes at once, and once all survivors share an ancestor, the edits up to it are final
and leave the task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Costs of the edits.
RENAME, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5

_START, _SYSTEM, _USER, _PAIR = range(4)  # nothing yet; after s; after u; after a pair (the end)
_KEEP = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _PAIR, (_PAIR, "u"): _USER}
_MADE = {_START: (_USER, "user"), _SYSTEM: (_USER, "user"), _USER: (_PAIR, "assistant"), _PAIR: (_USER, "user")}
# What a survivor of the first state may cost more and still do all that one of the second may: a state's rows to come are
# taken from another state with a first turn deleted instead of kept, or with the missing turns inserted.
_INSTEAD = {(_PAIR, _START): DELETE, (_PAIR, _SYSTEM): 0, (_PAIR, _USER): INSERT, (_USER, _PAIR): INSERT, (_USER, _START): INSERT + DELETE, (_USER, _SYSTEM): INSERT, (_START, _SYSTEM): 0, (_START, _PAIR): 0, (_START, _USER): INSERT}

_WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


class _Node:
    """An edit. ``jump`` is an ancestor further up, so that the meeting point of two branches is found in logarithmic steps."""

    __slots__ = ("parent", "jump", "depth", "edit", "row", "role", "cost", "refs", "kids")

    def __init__(self, parent: _Node | None, edit: str = "", row: tuple | None = None, role: str | None = None, cost: int = 0) -> None:
        self.parent, self.edit, self.row, self.role, self.cost = parent, edit, row, role, cost
        self.refs, self.kids = 0, []
        if parent is None:
            self.depth, self.jump = 0, self
            return
        self.depth = parent.depth + 1
        far = parent.jump
        self.jump = far.jump if parent.depth - far.depth == far.depth - far.jump.depth else parent


def _less(a: _Node, b: _Node) -> bool:
    """Whether the edits up to ``a`` come before those up to ``b`` in ASCII order, over the whole of their unresolved suffixes.

    Below the node where they part, two branches differ at once: the same edit of the same row would be the same node.
    """
    first, second = a, b
    while a.depth > b.depth:
        a = a.jump if a.jump.depth >= b.depth else a.parent
    while b.depth > a.depth:
        b = b.jump if b.jump.depth >= a.depth else b.parent
    if a is b:
        return first.depth < second.depth
    while a.parent is not b.parent:
        if a.jump is b.jump:
            a, b = a.parent, b.parent
        else:
            a, b = a.jump, b.jump
    return a.edit < b.edit


class Repair:
    """The survivors of one conversation. Rows are (role, text, fault, …) tuples; ``push`` and ``end`` give the edits that are final by then."""

    def __init__(self) -> None:
        self.root = _Node(None)
        self.alive: dict[int, tuple[int, _Node]] = {_START: (0, self.root)}
        self.root.refs = 1

    def _advance(self, options: list[tuple[int, int, _Node, str, tuple | None, str | None, int]]) -> dict[int, tuple[int, _Node]]:
        """Of ``options`` (state, cost, node so far, edit, row, role, cost of the edit) the best of each state."""
        best: dict[int, tuple[int, _Node]] = {}
        for state, cost, before, edit, row, role, own in options:
            now = best.get(state)
            if now and now[0] < cost:
                continue
            node = _Node(before, edit, row, role, own) if edit else before
            if now and now[0] == cost and not _less(node, now[1]):
                continue
            best[state] = (cost, node)
        return best

    def _inserted(self, alive: dict[int, tuple[int, _Node]]) -> dict[int, tuple[int, _Node]]:
        """With inserted turns: at most a user's turn, then an assistant's; more would come back to a state at a higher cost."""
        for target in (_USER, _PAIR):
            options = [(target, *alive[target], "", None, None, 0)] if target in alive else []
            for state, (made, role) in _MADE.items():
                if made == target and state in alive:
                    cost, node = alive[state]
                    options.append((target, cost + INSERT, node, "I", None, role, INSERT))
            alive = alive | self._advance(options)
        return alive

    def push(self, row: tuple) -> list[_Node]:
        role, _, fault = row[:3]
        late = TRUNCATED if fault == "truncated" else 0
        options = []
        for state, (cost, node) in self._inserted(self.alive).items():
            options.append((state, cost + DELETE, node, "D", row, None, DELETE))
            if fault in ("blank", "duplicate"):
                continue
            if (to := _KEEP.get((state, role[:1]))) is not None:
                options.append((to, cost + late, node, "K", row, role, late))
            to, made = _MADE[state]
            options.append((to, cost + RENAME + late, node, "R", row, made, RENAME + late))
        best = self._advance(options)
        kept = {s: v for s, v in best.items() if not any(best[t][0] + more < v[0] for (t, other), more in _INSTEAD.items() if other == s and t in best)}
        return self._settle(kept)

    def end(self) -> list[_Node]:
        every = self._inserted(self.alive)
        final = [every[s] for s in (_START, _PAIR) if s in every]
        cost = min(c for c, _ in final)
        nodes = [n for c, n in final if c == cost]
        best = nodes[0] if len(nodes) == 1 or _less(nodes[0], nodes[1]) else nodes[1]
        return self._settle({_PAIR: (cost, best)})

    def _hold(self, node: _Node) -> None:
        node.refs += 1
        while node.refs == 1 and node.parent is not None:
            node.parent.kids.append(node)
            node = node.parent
            node.refs += 1

    def _release(self, node: _Node) -> None:
        node.refs -= 1
        while node.refs == 0 and node.parent is not None:
            up = node.parent
            up.kids.remove(node)
            node.parent = node.jump = None
            up.refs -= 1
            node = up

    def _settle(self, alive: dict[int, tuple[int, _Node]]) -> list[_Node]:
        """Takes over the survivors and gives the edits that all of them share."""
        for _, node in alive.values():
            self._hold(node)
        for _, node in self.alive.values():
            self._release(node)
        low = min(c for c, _ in alive.values())
        leaves = {id(n) for _, n in alive.values()}
        self.alive = {s: (c - low, n) for s, (c, n) in alive.items()}
        out = []
        while len(self.root.kids) == 1 and id(self.root) not in leaves:
            top, self.root = self.root, self.root.kids[0]
            top.parent = None
            top.kids = []
            out.append(self.root)
        self.root.parent = None
        return out


def fault(text: str, seen: bool) -> str | None:
    """A row's first fault: 'blank', 'duplicate' (``seen``: role and text came earlier) or 'truncated'."""
    bare = text.rstrip(_WHITE)
    if not bare:
        return "blank"
    if seen:
        return "duplicate"
    return None if bare[-1] in ".!?" else "truncated"


_OUT = "place bigint, edit string, cost int, fault string, turn bigint, old_role string, role string, text string, present boolean"


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """One row per edit of each conversation, in order: conv_id, ``place`` (from 0), ``edit`` ('K' keep, 'R' new role, 'D' delete, 'I' insert), ``cost``, ``fault``, turn, ``old_role``, and the repaired row's ``role`` and ``text`` (null where deleted).

    ``conversations`` has conv_id, turn, role, text; rows are taken by turn (nulls first), role and text. Null roles and texts
    count as one space, a null conv_id as a conversation. A conversation whose rows have no ``present`` (an optional
    boolean column) has one row with a null edit, so that it isn't lost. Repeated rows are duplicates of the first; other columns are
    ignored; an empty table gives no rows.

    The edits of a conversation come one after the other within a partition. Conversations are dealt to tasks, which read
    sorted rows and hold the tree: its size is that of the edits on which survivors differ, a few rows in general. It
    grows while two survivors stay apart for long, as where all rows have one role. A conversation isn't split among tasks, since
    each edit depends on the ones before.
    """
    present = F.coalesce("present", F.lit(False)) if "present" in conversations.columns else F.lit(True)
    df = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), present.alias("present"))
    same = Window.partitionBy("conv_id", "role", "text", "present").orderBy(F.col("turn").asc_nulls_first())
    seen = df.repartition("conv_id").withColumn("seen", F.row_number().over(same) > 1)
    ordered = seen.sortWithinPartitions(F.col("conv_id"), F.col("present").desc(), F.col("turn").asc_nulls_first(), "role", "text", "seen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        repair, place, out, held = Repair(), 0, [], 0
        key_type = None

        def final(nodes: list[_Node]) -> None:
            nonlocal place, held
            for n in nodes:
                role, text, why, turn = n.row or (None, "", None, None)
                n.row, gone = None, n.edit == "D"
                out.append((now[0], place, n.edit, n.cost, why, turn, role, n.role, None if gone else text, True))
                held += len(text)
                place += 1

        def packed() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * 10
            kinds = [key_type, pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["conv_id", *[x.split()[0] for x in _OUT.split(", ")]])

        for batch in batches:
            key_type = batch.schema.field("conv_id").type
            for conv, turn, role, text, there, again in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "present", "seen")]):
                if now != (conv,):
                    if now is not None:
                        final(repair.end())
                    now, repair, place = (conv,), Repair(), 0
                    if not there:
                        out.append((conv, None, None, None, None, None, None, None, None, False))
                if there:
                    final(repair.push((role, text, fault(text, again), turn)))
                if len(out) >= 10_000 or held >= 1 << 24:
                    yield packed()
                    out, held = [], 0
        if now is not None:
            final(repair.end())
        if out:
            yield packed()

    return ordered.mapInArrow(run, f"conv_id {df.schema['conv_id'].dataType.simpleString()}, {_OUT}")


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with the faults of a reproducible test: by crc32 of ``conv_id:turn`` modulo 20, a row is dropped (0), emptied (1), loses its ``.!?`` (2), is repeated (3) or becomes the user's (4). Dropped rows stay with ``present`` false."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    df = conversations.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind").isin(0, 1), "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_kind") == 3, 2).otherwise(1)
    df = df.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_kind") != 0).alias("present"), F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy"))
    return df.drop("_copy")


_DIGEST = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def audits(edits: DataFrame) -> DataFrame:
    """Per conversation of ``repair_conversations``: gaps between turns, rows by fault, illegal neighbours, cost, the edits' letters and the hash of the repaired conversation.

    Reads the edits as they come, in their order within the partition, so it must follow ``repair_conversations``
    without a shuffle between. A task holds one conversation's letters and running hash.
    """
    names = ["conv_id", *[x.split()[0] for x in _DIGEST.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out, key_type = None, None, [], None

        def closed() -> tuple:
            turns = state["turns"]
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            return (now[0], gaps, *[state[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost")], "".join(state["audit"]), state["sha"].hexdigest())

        def packed() -> pa.RecordBatch:
            kinds = [key_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

        for batch in batches:
            key_type = batch.schema.field("conv_id").type
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "edit", "cost", "fault", "turn", "old_role", "role", "text", "present")]
            for conv, edit, cost, why, turn, old, role, text, there in zip(*columns):
                if now != (conv,):
                    if now is not None:
                        out.append(closed())
                    now = (conv,)
                    state = {"turns": None, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "last": None, "any": False}
                if not there:
                    continue
                state["audit"].append(edit)
                state["cost"] += cost
                if edit != "I":
                    if why:
                        state[why] += 1
                    if state["last"] is not None and state["last"] + old[:1] not in ("su", "ua", "au"):
                        state["illegal"] += 1
                    state["last"] = old[:1]
                    if turn is not None:
                        t = state["turns"]
                        state["turns"] = (t[0], turn, t[2] + (turn != t[1])) if t else (turn, turn, 1)
                if edit != "D":
                    state["sha"].update(("\n" if state["any"] else "").encode() + f"{role}:{text}".encode())
                    state["any"] = True
                if len(out) >= 5_000:
                    yield packed()
                    out = []
        if now is not None:
            out.append(closed())
        if out:
            yield packed()

    return edits.mapInArrow(run, f"conv_id {edits.schema['conv_id'].dataType.simpleString()}, {_DIGEST}")

"""Edit-aware token counts: pre-token segment trees that re-encode only what an edit touches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import cut_safely, tokenizer

_CHUNK, _FAN, _PIECE = 64, 16, 1 << 20
#: Starting a match needs at most this many characters after it; an edit nearer than that can change it.
_AHEAD = 3


class _Counts(dict):
    """Tokens of a pre-token, encoded once; emptied when it has gathered many."""

    def __init__(self, path: str):
        self.ids = tokenizer(path).ids

    def __missing__(self, pretoken: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        n = self[pretoken] = len(self.ids(pretoken))
        return n


class PreTokens:
    """Splits texts as the vocabulary's pre-tokeniser does, and counts the tokens of each part."""

    def __init__(self, path: str):
        import regex

        # Fixed value: the pattern of byte-level BPE pre-tokenisers.
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.counts = _Counts(path)
        added = [t for t in tokenizer(path).added if t]
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

    def split(self, text: str) -> list[str]:
        """The parts of ``text`` in order, of a long text chunk by chunk."""
        if self.added is not None and self.added.search(text):
            parts = self.added.split(text)
            return [p for k, part in enumerate(parts) for p in ([part] if k % 2 else self.pattern.findall(part))]
        return self.pattern.findall(text)

    def measure(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and token counts of the parts of ``text``; a long text is split chunk by chunk."""
        chunks = [text] if len(text) <= _PIECE or self.added is not None and self.added.search(text) else cut_safely(text, _PIECE)
        out = []
        for chunk in chunks:
            parts = self.split(chunk)
            out.append((np.fromiter(map(len, parts), np.int64, len(parts)), np.fromiter(map(self.counts.__getitem__, parts), np.int64, len(parts))))
        return (np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])) if len(out) > 1 else out[0]

    def number(self, parts: list[str]) -> list[int]:
        return list(map(self.counts.__getitem__, parts))


@lru_cache(maxsize=1)
def pre_tokens(path: str) -> PreTokens:
    return PreTokens(path)


class SegmentTree:
    """Lengths and token counts of a text's pre-tokens, in leaves of ``_CHUNK`` under inner nodes that hold their sums.

    An edit gives new leaves to the chunks it touches; a leaf that grows beyond ``_CHUNK`` is split. The sums of all
    other leaves stay as they are, and inner nodes add up the leaves below them again.
    """

    def __init__(self, lengths: np.ndarray, tokens: np.ndarray):
        self.leaves: list[tuple[np.ndarray, np.ndarray]] = []
        self._raise(self._add(np.asarray(lengths, np.int64), np.asarray(tokens, np.int64)))

    def _add(self, lengths: np.ndarray, tokens: np.ndarray) -> list[np.ndarray]:
        """Appends leaves; their sums of characters, tokens and pre-tokens."""
        n = len(lengths)
        if not n:
            return []
        at = np.arange(0, n, _CHUNK)
        self.leaves += [(lengths[a : a + _CHUNK], tokens[a : a + _CHUNK]) for a in at.tolist()]
        return [np.stack([np.add.reduceat(lengths, at), np.add.reduceat(tokens, at), np.diff(at, append=n)], axis=1)]

    def _raise(self, sums: list[np.ndarray]) -> None:
        if not self.leaves:
            none = np.zeros(0, np.int64)
            self.leaves, sums = [(none, none)], [np.zeros((1, 3), np.int64)]
        self.levels = [np.concatenate(sums) if len(sums) > 1 else sums[0]]
        while len(self.levels[-1]) > 1:
            level = self.levels[-1]
            self.levels.append(np.add.reduceat(level, np.arange(0, len(level), _FAN), axis=0))

    @property
    def total(self) -> tuple[int, int, int]:
        """(characters, tokens, pre-tokens) of the text."""
        return tuple(self.levels[-1][0].tolist())

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character ``at`` (the last one, beyond the end), and where it begins."""
        node, before = 0, 0
        for level in self.levels[-2::-1]:
            node *= _FAN
            below = np.cumsum(level[node : node + _FAN, 0])
            k = min(int(np.searchsorted(below, at - before, "right")), len(below) - 1)
            before += int(below[k - 1]) if k else 0
            node += k
        return node, before

    def edges(self, leaf: int, before: int) -> np.ndarray:
        """Where the leaf's pre-tokens begin, and its end."""
        return before + np.concatenate(([0], np.cumsum(self.leaves[leaf][0])))

    def replace(self, changes: list[tuple[tuple[int, int], tuple[int, int], np.ndarray, np.ndarray]]) -> None:
        """Puts new pre-tokens (lengths, tokens) in place of those from one (leaf, index) to another; changes in order and apart."""
        old, sums = self.leaves, self.levels[0]
        self.leaves, kept, at, held = [], [], 0, []
        for k, ((first, a), (last, b), lengths, tokens) in enumerate(changes):
            begin = 0
            if held:  # in the leaf where the change before ended
                begin = changes[k - 1][1][1]
            else:
                self.leaves += old[at:first]
                kept.append(sums[at:first])
            held += [(old[first][0][begin:a], old[first][1][begin:a]), (lengths, tokens)]
            if k + 1 == len(changes) or changes[k + 1][0][0] > last:
                held.append((old[last][0][b:], old[last][1][b:]))
                kept += self._add(*(np.concatenate(x) for x in zip(*held)))
                held, at = [], last + 1
        self.leaves += old[at:]
        kept.append(sums[at:])
        self._raise(kept)

    def packed(self) -> bytes:
        """Little-endian 32-bit numbers: how many leaves, their lengths, their tokens."""
        lengths, tokens = (np.concatenate(x) for x in zip(*self.leaves))
        return np.concatenate(([len(lengths)], lengths, tokens)).astype("<u4").tobytes()

    @classmethod
    def read(cls, packed: bytes) -> SegmentTree:
        """The tree of ``packed``."""
        numbers = np.frombuffer(packed, "<u4").astype(np.int64)
        n = int(numbers[0])
        return cls(numbers[1 : n + 1], numbers[n + 1 :])


def apply_edits(text: str, tree: SegmentTree, edits: list[tuple[int, int, str]], pre: PreTokens) -> tuple[str, int]:
    """The edited text and how many pre-tokens were encoded again; ``tree`` becomes that of the edited text.

    ``edits`` (start, end, replacement) are in characters of ``text``, sorted and apart. The text is put together once.
    For each edit matching restarts at a boundary far enough before it to be the same in both texts, and goes on
    until, past the edit, it meets a boundary of the old tree again: from there on nothing changes until the next
    edit. A text that has a special token's string, before or after, is split anew as a whole.
    """
    out, at = [], 0
    for start, end, new in edits:
        out += [text[at:start], new]
        at = end
    whole = "".join([*out, text[at:]])
    if pre.added is not None and (pre.added.search(text) or pre.added.search(whole)):
        tree.__init__(*pre.measure(whole))
        return whole, tree.total[2]
    changes, encoded = [], 0
    done, shift, k = 0, 0, 0
    while k < len(edits):
        start = edits[k][0]
        first, before = tree.find(max(done, start - _AHEAD))
        while True:  # a boundary with no white space before it, so no match over a run of it is pending
            edges = tree.edges(first, before)
            fit = [e for e in edges[(edges >= done) & (edges <= start - _AHEAD)].tolist() if e == done or not text[e - 1].isspace()]
            if fit or before <= done:
                break
            first -= 1
            before -= int(tree.levels[0][first][0])
        restart = fit[-1] if fit else done
        begin = first, int(np.searchsorted(edges, restart))
        parts: list[str] = []
        at, past, grown = restart + shift, restart, shift
        matches = pre.pattern.finditer(whole, at)
        leaf = first
        while True:
            while k < len(edits) and edits[k][0] - _AHEAD < at - grown:
                start, past, new = edits[k]
                grown += len(new) - (past - start)
                k += 1
            here = at - grown
            if here >= past and at > restart + shift:
                while edges[-1] < here and leaf + 1 < len(tree.leaves):
                    leaf += 1
                    edges = tree.edges(leaf, int(edges[-1]))
                meet = int(np.searchsorted(edges, here))
                if meet < len(edges) and edges[meet] == here:
                    break
            m = next(matches, None)
            if m is None:
                if k < len(edits):  # an edit at the end that deletes, or is of nothing
                    at = len(whole)
                    past, grown = edits[-1][1], len(whole) - len(text)
                    k = len(edits)
                leaf = len(tree.leaves) - 1
                meet, here = len(tree.leaves[leaf][0]), len(text)
                break
            parts.append(m[0])
            at = m.end()
        encoded += len(parts)
        changes.append((begin, (leaf, meet), np.array(list(map(len, parts)), np.int64), np.array(pre.number(parts), np.int64)))
        done, shift = here, grown
    tree.replace(changes)
    return whole, encoded


def edited_token_counts(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None, keep: bool = False, tree_col: str | None = None
) -> DataFrame:
    """One row per row of ``docs``: counts of its text, and of what the edits make of it.

    Columns: id, ``n_chars``, ``n_pretokens``, ``n_tokens``, ``n_edits``, ``n_tokens_after``, ``n_reencoded`` (pre-tokens
    encoded again for the edits), and with ``keep`` also ``text_after`` and ``tree`` (the edited text's leaves).
    ``tree_col`` is such a tree of the text from an earlier run: with it only what the edits touch is split and
    encoded. A row whose tree is null or of a text of another length is encoded as a whole.
    ``edits_col`` is an array of structs (start, end, text) in characters of the text; sorted here, of edits that
    overlap the earlier one counts, and offsets past the end mean the end. Null texts are empty, null edits none.
    Texts of any length are split in chunks, and the time for edits grows with their number and the text's length.
    Ids are passed on, null or repeated; other columns are ignored; an empty table gives no rows. It is one pass
    without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = pre_tokens(tokenizer_path)
        for batch in batches:
            out: list[tuple] = []
            texts, edits, trees = batch.column(1), batch.column(2), batch.column(3)
            for k in range(batch.num_rows):
                text = texts[k].as_py() or ""
                tree = SegmentTree.read(packed) if (packed := trees[k].as_py()) else None
                if tree is None or tree.total[0] != len(text):
                    tree = SegmentTree(*pre.measure(text))
                chars, tokens, leaves = tree.total
                own, at = [], 0
                for e in sorted(edits[k].as_py() or (), key=lambda e: (e["start"], e["end"])):
                    if e["start"] >= at:
                        own.append((min(e["start"], chars), min(max(e["end"], e["start"]), chars), e["text"] or ""))
                        at = max(e["end"], e["start"])
                after, encoded = apply_edits(text, tree, own, pre) if own else (text, 0)
                out.append((chars, leaves, tokens, len(own), tree.total[1], encoded, *((after, tree.packed()) if keep else ())))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 6 + [pa.string(), pa.binary()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    names = [id_col, "n_chars", "n_pretokens", "n_tokens", "n_edits", "n_tokens_after", "n_reencoded", *(["text_after", "tree"] if keep else [])]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{n} bigint" for n in names[1:7]) + (", text_after string, tree binary" if keep else "")
    none = F.lit(None).cast("array<struct<start:int,end:int,text:string>>")
    tree = F.col(tree_col) if tree_col else F.lit(None).cast("binary")
    return docs.select(id_col, text_col, F.col(edits_col) if edits_col else none.alias("edits"), tree.alias("tree")).mapInArrow(run, schema)

"""Language-model scoring: prediction by partial matching over byte contexts, and a word unigram base."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import written

#: Contexts of up to this many bytes are in one small table; longer ones are dealt by their last bytes.
_LOW = 2
#: Bytes that UTF-8 never has: before a text, and its end.
_BEFORE, _END = 0xFE, 0xFF
_END_WORD = np.uint64(0x5851F42D4C957F2D)
_WORD, _GRAM, _BASE, _TOTAL = range(4)
#: Bytes of text that are worked on at once; each takes some 60 bytes of a worker's memory meanwhile.
_PIECE = 1 << 20


def _grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte and end of every text the ``order`` bytes before it and itself as one number, and where rows begin."""
    n, rows = len(data), len(offsets) - 1
    padded = np.full(n + (order + 1) * rows, _BEFORE, np.uint8)
    shift = np.arange(rows, dtype=np.int64) * (order + 1) + order
    padded[np.arange(n) + np.repeat(shift, np.diff(offsets))] = data
    padded[offsets[1:] + shift] = _END
    gram = np.zeros(max(len(padded) - order, 0), np.int64)
    for k in range(order + 1):
        gram <<= 8
        gram |= padded[k : len(padded) - order + k]
    own = (gram & 255) != _BEFORE
    return gram[own], offsets[:-1] + np.arange(rows)


def _gram_parts(data: np.ndarray, offsets: np.ndarray, order: int, most: int = _PIECE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``_grams`` of some rows; of a long text, which is alone, part after part, and the rows' places each time."""
    if len(data) <= 2 * most or len(offsets) != 2:
        yield _grams(data, offsets, order)
        return
    for a in range(0, len(data), most):
        part = data[max(0, a - order) : a + most]
        own = _grams(part, np.array([0, len(part)]), order)[0]
        yield own[min(a, order) : None if a + most >= len(data) else -1], np.zeros(1, np.int64)


def _row_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words with an end token after each row's, the last bit cleared, and where rows begin."""
    h, first = _text.hashed_words(data, offsets)
    h = np.insert(h, first[1:], _END_WORD)
    return h.view(np.int64) & ~np.int64(1), first + np.arange(len(offsets))


def _reduced(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of ``keys``, which are in order, and the sum of each one's counts."""
    if not len(keys):
        return keys, n
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first)


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's counts."""
    order = np.argsort(keys, kind="stable")
    return _reduced(keys[order], n[order])


class _Counter:
    """Counts of integer keys in tables, each at least twice as large as the next; one that isn't takes the next in."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, values: np.ndarray) -> None:
        self.parts.append(np.unique(values, return_counts=True))
        while len(self.parts) > 1 and len(self.parts[-2][0]) < 2 * len(self.parts[-1][0]):
            self._join()

    def _join(self) -> None:
        # the new keys are put in place, without sorting or copying both tables at once
        (more, m), (keys, n) = sorted((self.parts.pop(), self.parts.pop()), key=lambda part: len(part[0]))
        at = np.searchsorted(keys, more)
        same = at < len(keys)
        same[same] = keys[at[same]] == more[same]
        n[at[same]] += m[same]
        new = ~same
        at, more, m = at[new], more[new], m[new]
        keys = np.insert(keys, at, more)
        self.parts.append((keys, np.insert(n, at, m)))

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        while len(self.parts) > 1:
            self._join()
        return self.parts[0] if self.parts else (np.empty(0, np.int64), np.empty(0, np.int64))


def _low_tables(grams: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For contexts of 0 to ``_LOW`` bytes: the contexts, and a row of 256 counts, probabilities and escapes of each.

    A context that saw a symbol gives it count / (all + distinct), else it escapes with distinct / (all + distinct)
    to the context one byte shorter, where the symbols it saw are excluded; after the empty context the 255 symbols
    that remain share evenly.
    """
    out: list[tuple] = []
    for k in range(_LOW + 1):
        g, m = _summed(grams & ((1 << 8 * (k + 1)) - 1), n)
        contexts, at = np.unique(g >> 8, return_inverse=True)
        if k == 0 and not len(contexts):
            contexts, at = np.zeros(1, np.int64), at
        counts = np.bincount(at * 256 + (g & 255), m, 256 * len(contexts)).reshape(-1, 256)
        seen, total = counts > 0, counts.sum(1, keepdims=True)
        kinds = seen.sum(1, keepdims=True)
        if k == 0:
            below = np.full(counts.shape, 1.0 / max(255 - int(kinds[0, 0]), 1))
        else:
            up_contexts, up, _, up_below = out[-1]
            i = np.searchsorted(up_contexts, contexts & ((1 << 8 * (k - 1)) - 1))
            up = up[i]
            below = _escape(up, up_below[i], (up * ~seen).sum(1, keepdims=True), (up > 0).sum(1, keepdims=True) - kinds)
        p = np.where(seen, counts, np.maximum(kinds, 1) * below) / np.maximum(total + kinds, 1)
        out.append((contexts, counts, p, below))
    return out


def _escape(up: np.ndarray, up_below: np.ndarray, left: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Probabilities in the shorter context, of whose counts ``left`` of ``more`` symbols aren't excluded."""
    scale = np.maximum(left + more, 1e-30)
    return np.where(up > 0, up / scale, np.where(more > 0, more / scale, 1.0) * up_below)


def _gram_scores(grams: np.ndarray, n: np.ndarray, low: list, order: int) -> np.ndarray:
    """log10 probability of each gram's last byte after the others.

    ``grams`` (in order) are all those of some contexts of ``_LOW`` + 1 bytes, with their counts in training, 0 for
    those that only need a score.
    """
    levels = [(grams, n, None)]
    for k in range(order - 1, _LOW, -1):
        own, own_n, _ = levels[-1]
        cut = own & ((1 << 8 * (k + 1)) - 1)
        g, m = _summed(cut, own_n)
        levels[-1] = (own, own_n, np.searchsorted(g, cut))
        levels.append((g, m, None))
    g = levels[-1][0]
    symbol = g & 255
    # the shorter context's values for every gram: symbol's count, probability and escape, all counts, distinct symbols
    up, p, below, total, kinds = (np.zeros(len(g)) for _ in range(5))
    for k, (contexts, counts, ps, belows) in enumerate(low):
        c = (g >> 8) & ((1 << 8 * k) - 1)
        at = np.minimum(np.searchsorted(contexts, c), max(len(contexts) - 1, 0))
        hit = np.flatnonzero(contexts[at] == c) if len(contexts) else np.empty(0, np.int64)
        at, s = at[hit], symbol[hit]
        p[hit] = ps[at, s]
        if k == _LOW:
            up[hit], below[hit], total[hit], kinds[hit] = counts[at, s], belows[at, s], counts.sum(1)[at], (counts > 0).sum(1)[at]
    for g, m, _ in reversed(levels):
        if g is not levels[-1][0]:
            i = next(x for o, _, x in levels if o is g)
            up, p, below, total, kinds = up[i], p[i], below[i], total[i], kinds[i]
        context, at = np.unique(g >> 8, return_inverse=True)
        seen = m > 0
        own_total, own_kinds = np.bincount(at, m)[at], np.bincount(at, seen)[at]
        excluded = np.bincount(at, up * seen)[at]
        escape = _escape(up, below, total - excluded, kinds - own_kinds)
        known = own_total > 0
        p = np.where(known, np.where(seen, m, own_kinds * escape) / np.maximum(own_total + own_kinds, 1), p)
        up, below, total, kinds = m.astype(np.float64), escape, own_total, own_kinds
    return np.log10(p)


def _packed(values: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes, dtype: type) -> np.ndarray:
    n, width = int.from_bytes(blob[:8], "little"), np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(blob[8:], n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(dtype).ravel()


def _dealt(kind: int, keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[int]]:
    """The order of keys by bucket, words by hash and grams by the last bytes of their context, and where buckets begin."""
    own = keys if kind == _WORD else keys >> 8 & ((1 << 8 * (_LOW + 1)) - 1)
    b = _text.mix(own.astype(np.uint64)) % np.uint64(buckets)
    order = np.argsort(b, kind="stable")
    return order, np.searchsorted(b[order], np.arange(buckets + 1, dtype=np.uint64)).tolist()


def _asked(order: int, buckets: list[int], unit_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """All rows with their unit, a run of about ``unit_bytes`` text (a longer text is a unit alone); and as rows of a kind
    each unit's distinct words and grams with their counts in training rows, dealt to buckets, and its short grams in training rows."""

    def emit(unit: int, counters: tuple[_Counter, _Counter], id_type: pa.DataType) -> pa.RecordBatch:
        out = []
        for kind, counter in zip((_WORD, _GRAM), counters):
            keys, n = counter.merged()  # the last bit: of a training row
            keys, n = _reduced(keys >> 1, n * (keys & 1))
            if kind == _GRAM:
                own = n > 0
                short, m = _summed(keys[own] & ((1 << 8 * (_LOW + 1)) - 1), n[own])
                out.append((_BASE, 0, _packed(short), _packed(m)))
            place, ends = _dealt(kind, keys, buckets[kind])
            keys, n = keys[place], n[place]
            out += [(kind, x, _packed(np.diff(keys[i:j], prepend=0)), _packed(n[i:j])) for x, (i, j) in enumerate(zip(ends[:-1], ends[1:])) if j > i]
        kind, bucket, keys, n = zip(*out)
        columns = [pa.array([unit] * len(out), pa.int64()), pa.nulls(len(out), id_type), pa.nulls(len(out), pa.string()), pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(keys, pa.binary()), pa.array(n, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["unit", "_id", "_text", "kind", "bucket", "keys", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, room, id_type = TaskContext.get().partitionId() << 32, unit_bytes, None
        counters = _Counter(), _Counter()
        for batch in batches:
            if not len(batch):
                continue
            id_type, rows, units = batch.column(0).type, len(batch), []
            train = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            sizes, start = np.diff(_text.buffers(batch.column(1))[1]).tolist(), 0
            for k in range(rows + 1):
                full = k < rows and sizes[k] > room and room < unit_bytes
                if full or k == rows:
                    for a, b, data, offsets in _text.pieces(batch.column(1).slice(start, k - start), _PIECE):
                        own = train[start + a : start + b]
                        h, first = _row_words(data, offsets)
                        counters[0].add(h | np.repeat(own, np.diff(first)))
                        for grams, _ in _gram_parts(data, offsets, order):
                            counters[1].add(grams << 1 | (np.repeat(own, np.diff(offsets) + 1) if len(own) > 1 else own))
                    units += [unit] * (k - start)
                    start = k
                if full:
                    yield emit(unit, counters, id_type)
                    counters, unit, room = (_Counter(), _Counter()), unit + 1, unit_bytes
                if k < rows:
                    room -= sizes[k]
            nothing = [pa.nulls(rows, t) for t in (pa.int32(), pa.int32(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), batch.column(0), batch.column(1), *nothing], ["unit", "_id", "_text", "kind", "bucket", "keys", "n"])
        if id_type is not None:
            yield emit(unit, counters, id_type)

    return run


_ANSWERS = "unit bigint, kind int, bucket int, answer binary"


def _answered(order: int, base: tuple[np.ndarray, np.ndarray] | None) -> Callable[[pa.Table], pa.Table]:
    """A bucket's words with their counts, or grams with their scores, for every unit as it asked; totals of words have no unit."""

    def run(table: pa.Table) -> pa.Table:
        units, kind, bucket = table["unit"].to_pylist(), table["kind"][0].as_py(), table["bucket"][0].as_py()
        asked = [np.cumsum(_unpacked(k, np.int64)) for k in table["keys"].to_pylist()]
        keys, n = _summed(np.concatenate(asked), np.concatenate([_unpacked(k, np.int64) for k in table["n"].to_pylist()]))
        value = n if kind == _WORD else _gram_scores(keys, n, _low_tables(*base), order).astype(np.float32)
        answers = [_packed(value[np.searchsorted(keys, own)]) for own in asked]
        kinds = [kind] * len(units)
        if kind == _WORD:
            units, kinds, answers = [*units, None], [*kinds, _TOTAL], [*answers, _packed(np.array([n.sum(), (n > 0).sum()], np.int64))]
        return pa.table({"unit": pa.array(units, pa.int64()), "kind": pa.array(kinds, pa.int32()), "bucket": pa.array([bucket] * len(units), pa.int32()), "answer": pa.array(answers, pa.binary())})

    return run


def _scored(order: int, buckets: list[int], train_tokens: int, known_words: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    spread = math.log10(train_tokens + 0.1 * (known_words + 1))

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        pieces = [p for chunk in rows["_text"].chunks for p in _text.pieces(chunk, _PIECE)]
        counters = _Counter(), _Counter()
        for _, _, data, offsets in pieces:  # what the unit asked, in the same order
            counters[0].add(_row_words(data, offsets)[0] >> 1)
            for grams, _ in _gram_parts(data, offsets, order):
                counters[1].add(grams)
        answers = sorted(zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), answers["answer"].to_pylist()))
        known = []
        for kind, dtype in ((_WORD, np.int64), (_GRAM, np.float32)):
            keys = counters[kind].merged()[0]
            value = np.empty(len(keys), dtype)
            value[_dealt(kind, keys, buckets[kind])[0]] = np.concatenate([_unpacked(a, dtype) for k, _, a in answers if k == kind])
            known.append((keys, value))
        (words, counts), (known_grams, scores) = known
        found: list[list[np.ndarray]] = [[], [], [], []]
        for _, _, data, offsets in pieces:
            h, first = _row_words(data, offsets)
            c = counts[np.searchsorted(words, h >> 1)].astype(np.float64)
            n = np.diff(first)
            found[0].append(n)
            found[1].append(np.add.reduceat((c > 0).astype(np.int64), first[:-1]))
            found[2].append(np.add.reduceat(np.log10((c + 0.1) / 0.1), first[:-1]) + n * (-1.0 - spread))
            total = np.zeros(len(n))
            for g, starts in _gram_parts(data, offsets, order):
                own, at = np.unique(g, return_inverse=True)
                total += np.add.reduceat(scores[np.searchsorted(known_grams, own)][at], starts, dtype=np.float64)
            found[3].append(total)
        columns = [pa.array(np.concatenate(x), t) for x, t in zip(found, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
        return pa.Table.from_arrays([rows["_id"], *columns], ["_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def ppm_scores(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", max_contexts: int = 1 << 17, max_words: int = 4_000_000, order: int = 3, unit_bytes: int = 1 << 25
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    ``score`` is the log10 probability of the text's bytes and its end under a byte-context trie of ``order`` (3 to 6,
    escapes by method C, with symbol exclusion) that is trained beforehand on the rows where ``train`` holds.
    ``base_score`` is a smoothed unigram model of lower-cased words, each text closed by one end token.

    Units of about ``unit_bytes`` text ask once for each of their distinct words and grams (a byte and the ``order``
    bytes before it), with their counts in training. The questions are dealt to buckets, words by hash and grams by
    the last three bytes of their context, so a bucket has all longer contexts of its own and adds up counts and
    scores them; the answers go back to their units by shuffle. There is a bucket for each 32 ``max_contexts`` bytes of
    text, for words each 8 ``max_words``, 4,096 at most. Only the totals and the grams of three
    bytes (whose number saturates) reach the driver. Null texts are empty and have the end token alone. Rows may
    repeat and have null ids. Without training rows all counts are 0, and all 255 symbols are alike.
    """
    if not _LOW < order <= 6:
        raise ValueError("order is 3 to 6")
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.coalesce(train, F.lit(False)).alias("_train"))
    size = rows.agg(F.sum(F.octet_length("_text") + 1)).first()[0] or 0
    buckets = [min(4096, max(1, math.ceil(size / most))) for most in (8 * max_words, 32 * max_contexts)]
    found = rows.mapInArrow(_asked(order, buckets, unit_bytes), f"unit bigint, _id {id_type}, _text string, kind int, bucket int, keys binary, n binary")
    found = written(found, "units")
    rows, asked = found.filter("kind is null").select("unit", "_id", "_text"), found.select("unit", "kind", "bucket", "keys", "n")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(_unpacked(keys, np.int64)), pa.array(_unpacked(n, np.int64))], ["key", "n"])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for answer in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in _unpacked(answer, np.int64)], ["tokens", "known"])

    base = asked.filter(F.col("kind") == _BASE).select("keys", "n").mapInArrow(counted, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    base = base["key"].to_numpy(), base["n"].to_numpy()
    words = written(asked.filter(F.col("kind") == _WORD).groupBy("kind", "bucket").applyInArrow(_answered(order, None), _ANSWERS), "words")
    tokens, known = words.filter(F.col("kind") == _TOTAL).select("answer").mapInArrow(totals, "tokens bigint, known bigint").agg(F.sum("tokens"), F.sum("known")).first()
    grams = asked.filter(F.col("kind") == _GRAM).groupBy("kind", "bucket").applyInArrow(_answered(order, base), _ANSWERS)
    answers = words.filter(F.col("kind") == _WORD).unionByName(grams)
    scored = rows.groupBy("unit").cogroup(answers.groupBy("unit"))
    scored = scored.applyInArrow(_scored(order, buckets, int(tokens or 0), int(known or 0)), f"_id {id_type}, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select(F.col("_id").alias(id_col), "n_tokens", "n_known", F.lit(int(tokens or 0)).cast("bigint").alias("train_tokens"), "base_score", "score")

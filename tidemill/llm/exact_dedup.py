"""Exact deduplication with counting quotient filters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import written

_U = np.uint64
_BLOCK = "slice int, block binary"


class CountingQuotientFilter:
    """A multiset of fingerprints of some bits: quotients by position, short remainders in sorted runs, counters between them.

    A fingerprint's high ``quotient_bits`` are its quotient, which isn't stored: a bit per possible quotient says which
    occur. The remainders of one quotient are a run of slots, in order; a bit per slot marks the end of a run. A
    fingerprint that occurs more than once has its count less one in the slots after its remainder, which a second
    bit per slot marks. Slots take the whole bytes that a remainder needs. Two filters add up by merging their
    sorted remainders, without loss.
    """

    def __init__(self, quotient_bits: int, remainder_bits: int):
        self.q, self.r = quotient_bits, remainder_bits
        self.width = max(1, (remainder_bits + 7) // 8)

    def pack(self, values: np.ndarray, counts: np.ndarray) -> bytes:
        """The filter of distinct sorted ``values`` with their counts."""
        quotient, remainder = (values >> _U(self.r)).astype(np.int64), values & _U((1 << self.r) - 1)
        occupied = np.zeros(1 << self.q, bool)
        occupied[quotient] = True
        more, digit = counts.astype(np.uint64) - _U(1), 8 * self.width
        digits, rest = np.zeros(len(values), np.int64), more.copy()
        while rest.any():
            digits += rest > 0
            rest = rest >> _U(digit) if digit < 64 else np.zeros_like(rest)
        at = np.concatenate(([0], np.cumsum(1 + digits)))
        slots, counter, end = np.zeros(int(at[-1]), np.uint64), np.zeros(int(at[-1]), bool), np.zeros(int(at[-1]), bool)
        slots[at[:-1]] = remainder
        for j in range(int(digits.max(initial=0))):
            own = np.flatnonzero(digits > j)
            place = at[own] + 1 + j
            slots[place] = more[own] >> _U(digit * j) & _U((1 << digit) - 1)
            counter[place] = True
        last = np.flatnonzero(np.append(quotient[1:] != quotient[:-1], True)) if len(values) else np.empty(0, np.int64)
        end[at[last + 1] - 1] = True
        body = slots.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self.width]
        head = np.array([self.q, self.r, len(slots)], "<i8")
        return b"".join([head.tobytes(), *(np.packbits(x).tobytes() for x in (occupied, end, counter)), body.tobytes()])

    @staticmethod
    def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Values and counts of a packed filter."""
        q, r, n = (int(x) for x in np.frombuffer(block, "<i8", 3))
        cqf, at, bits = CountingQuotientFilter(q, r), 24, []
        for size in (1 << q, n, n):
            raw = np.frombuffer(block, np.uint8, (size + 7) // 8, at)
            bits.append(np.unpackbits(raw, count=size).astype(bool))
            at += len(raw)
        occupied, end, counter = bits
        slots = np.zeros((n, 8), np.uint8)
        slots[:, : cqf.width] = np.frombuffer(block, np.uint8, n * cqf.width, at).reshape(n, cqf.width)
        slots = slots.view("<u8").ravel()
        first = np.flatnonzero(~counter)
        run = np.cumsum(end) - end
        values = np.flatnonzero(occupied)[run[first]].astype(np.uint64) << _U(r) | slots[first]
        counts, digits = np.ones(len(first), np.int64), np.diff(np.append(first, n)) - 1
        for j in range(int(digits.max(initial=0))):
            own = np.flatnonzero(digits > j)
            counts[own] += (slots[first[own] + 1 + j] << _U(8 * cqf.width * j)).astype(np.int64)
        return values, counts

    @staticmethod
    def merge(blocks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Values and counts of the sum of packed filters."""
        parts = [CountingQuotientFilter.unpack(b) for b in blocks]
        values, counts = np.concatenate([v for v, _ in parts]), np.concatenate([c for _, c in parts])
        order = np.argsort(values, kind="stable")  # each part is a sorted run
        values, counts = values[order], counts[order]
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)
        return values[first], np.add.reduceat(counts, first) if len(first) else counts


def fingerprint_bits(rows: int) -> int:
    """Bits of fingerprints for so many rows: a row whose text nobody shares is taken for repeated with a chance of 2 ** -16."""
    return min(62, max(20, rows.bit_length() + 16))


def fingerprint(text: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 64 - bits)


def repeated_fingerprints(prints: DataFrame, column: str, rows: int, bits: int, per_slice: int = 2_000_000) -> DataFrame:
    """The fingerprints (bigint ``column`` of ``bits`` bits) that occur more than once.

    Each partition builds a counting quotient filter for each slice of the table, with about as many quotients as it
    has fingerprints there; the slices are shuffled and merged. A slice has about ``per_slice`` distinct
    fingerprints, however many rows there are, and a fingerprint that many rows share leaves each partition once,
    with its count.
    """
    high = min(16, max(3, math.ceil(math.log2(max(1, rows / per_slice)))))
    low = bits - high

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for b in batches]
        if not held:
            return
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        slices = (values >> _U(low)).astype(np.int64)
        values &= _U((1 << low) - 1)
        cuts = [0, *(np.flatnonzero(slices[1:] != slices[:-1]) + 1).tolist(), len(values)]
        out = []
        for a, b in zip(cuts, cuts[1:]):
            q = min(low - 1, (b - a).bit_length())
            out.append((int(slices[a]), CountingQuotientFilter(q, low - q).pack(values[a:b], counts[a:b])))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], ["slice", "block"])

    def merge(key: tuple, blocks: pa.Table) -> pa.Table:
        values, counts = CountingQuotientFilter.merge(blocks["block"].to_pylist())
        values = values[counts > 1] | _U(key[0].as_py() << low)
        return pa.table({column: values.view(np.int64)})

    return prints.select(column).mapInArrow(build, _BLOCK).groupBy("slice").applyInArrow(merge, f"{column} bigint")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 2_000_000, hot_rows: int = 100_000, hot_groups: int = 100_000) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when identical; a null text counts as empty. Of equal texts the row with the largest id is
    kept. Fingerprints that the merged filters count once need nothing more: their rows leave without a shuffle.
    The others are routed to verification, which groups their rows by all bytes of the text (combined in each
    partition first), so texts that merely share a fingerprint stay apart. The filter's verdict is broadcast while it
    has at most ``broadcast_rows`` fingerprints (8 bytes each) and joined by shuffle beyond. Groups of more than
    ``hot_rows`` rows, and of more than the ``hot_groups``-th part of all rows, reach their rows by broadcast: there are fewer than
    ``hot_groups`` of them at any size. All others do by shuffle.

    Texts of any length are hashed and compared as a whole. Rows that repeat an id and a text are equal rows: all of
    them have ``kept`` if their id is the largest. A row without id is kept only where no row of its group has an id.
    Other columns are ignored, an empty table gives no rows.
    """
    rows = docs.count()
    hot_rows = max(hot_rows, rows // hot_groups)
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), fingerprint(text, fingerprint_bits(rows)).alias("_print"))
    repeated = _repeated(keyed, rows, broadcast_rows)
    groups = keyed.join(repeated, "_print", "left_semi").groupBy("_print", "_text").agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = written(groups.select("_print", F.sha2("_text", 256).alias("text_sha256"), "keep_id", "group_size"), "groups")
    hashed = keyed.select("_id", "_print", F.sha2("_text", 256).alias("text_sha256"))
    key = ["_print", "text_sha256"]
    alone = hashed.join(repeated, "_print", "left_anti").withColumns({"keep_id": F.col("_id"), "group_size": F.lit(1).cast("bigint")})
    several = hashed.join(repeated, "_print", "left_semi")
    hot, other = F.col("group_size") > hot_rows, F.col("group_size") <= hot_rows
    near = several.join(F.broadcast(groups.filter(hot)), key, "left")
    far = near.filter("group_size is null").select("_id", *key).join(groups.filter(other), key)
    columns = ["_id", "keep_id", "group_size", "text_sha256"]
    out = alone.select(columns).union(near.filter("group_size is not null").select(columns)).union(far.select(columns))
    kept = F.col("_id").eqNullSafe(F.col("keep_id"))
    return out.select(F.col("_id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with all their columns; of equal rows one.

    Only rows whose fingerprint is repeated are shuffled. Of rows of equal text and id, the largest by the other
    columns stays, which have to be of comparable types.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.count()
    keyed = docs.select(F.struct("*").alias("_row"), fingerprint(text, fingerprint_bits(rows)).alias("_print"), text.alias("_text"))
    repeated = _repeated(keyed, rows, broadcast_rows)
    row = F.col("_row")
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    best = F.max(F.struct(row[id_col], *[row[c] for c in rest], row[text_col].isNull().alias("_null"))).alias("_best")
    groups = keyed.join(repeated, "_print", "left_semi").groupBy("_print", "_text").agg(best)
    back = [F.when(~F.col("_best._null"), F.col("_text")).alias(c) if c == text_col else F.col("_best")[c].alias(c) for c in docs.columns]
    return keyed.join(repeated, "_print", "left_anti").select("_row.*").union(groups.select(back))


def _repeated(keyed: DataFrame, rows: int, broadcast_rows: int) -> DataFrame:
    """The repeated fingerprints, marked for broadcast while they are few."""
    repeated = written(repeated_fingerprints(keyed, "_print", rows, fingerprint_bits(rows)), "repeated")
    return F.broadcast(repeated) if repeated.count() <= broadcast_rows else repeated

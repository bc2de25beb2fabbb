"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import written

_U = np.uint64
STEMS = (4, 6, 8)
_PAIR, _SKIP = _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)


@dataclass(frozen=True)
class Settings:
    """``bits``: of the feature space. ``sample_rows``: about so many labelled rows are used at most; so many
    ``shard_rows`` are learned in one task, and the tasks' weights are averaged."""

    bits: int = 22
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.1
    epochs: int = 6
    shard_rows: int = 8_000
    sample_rows: int = 32_000
    seed: int = 11


def _features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word, its stems, every word pair and pair around one word; both may repeat.

    A stem is a word cut after some bytes: languages that compound and inflect repeat few whole words.
    """
    starts, ends, first = _text.words(data, offsets)
    h = _text.word_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    shift = _U(64 - bits)
    out, rows = [h >> shift], [row]
    for length in STEMS:
        long = np.flatnonzero(ends - starts > length)
        stem = _text.word_hashes(data, starts[long], starts[long] + length)
        out.append(_text.mix(stem ^ _U(length)) >> shift)
        rows.append(row[long])
    for gap, odd in ((1, _PAIR), (2, _SKIP)):
        if len(h) > gap:
            inside = row[gap:] == row[:-gap]
            out.append((_text.mix(h[:-gap] * odd + h[gap:]) >> shift)[inside])
            rows.append(row[gap:][inside])
    return np.concatenate(rows), np.concatenate(out).astype(np.int64)


def _distinct(data: np.ndarray, offsets: np.ndarray, bits: int, used: np.ndarray | None = None) -> np.ndarray:
    """Distinct (row, feature) pairs as row << 40 | feature, in order; only features that are ``used``. A long text goes part by part."""
    if len(data) > 1 << 23 and len(offsets) == 2:
        parts = [_distinct(part, np.array([0, len(part)]), bits, used) for part in _text.long_parts(data, 2)]
        out = parts[0]
        for part in parts[1:]:
            out = np.union1d(out, part)
        return out
    row, feature = _features(data, offsets, bits)
    if used is not None:
        hit = np.flatnonzero(used[feature])
        row, feature = row[hit], feature[hit]
    return np.unique((row.astype(np.int64) << 40) | feature)


class Ftrl:
    """FTRL-proximal with a rate per coordinate; coordinate ``2 ** bits`` is the bias, which has no L1 term."""

    def __init__(self, s: Settings):
        self.s = s
        self.z = np.zeros((1 << s.bits) + 1)
        self.n = np.zeros((1 << s.bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        s, z, n = self.s, self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, s.l1)
        w = -(z - np.sign(z) * l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        more = np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])
        self.z[at] += g - more / self.s.alpha * w
        self.n[at] += g * g


def fit(rows: DataFrame, count: int, settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights, nonzero ones only, from about ``count`` ``rows (text, label, id)``.

    Each task learns from its share of the rows, which ``sample_rows`` bounds, in an order that doesn't depend on how
    they arrive; the tasks' sparse weights are averaged by coordinate and are what reaches the driver.
    """
    s = settings
    bias = 1 << s.bits

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = Ftrl(s), []
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in _text.pieces(batch.column(0)):
                pairs = _distinct(data, offsets, s.bits)
                cut = np.searchsorted(pairs, np.arange(b - a + 1, dtype=np.int64) << 40)
                own = (pairs & ((1 << 40) - 1)).astype(np.int32)
                seen += [(np.append(own[x:y], np.int32(bias)), float(v)) for x, y, v in zip(cut[:-1], cut[1:], labels[a:b])]
        seen.sort(key=lambda r: (len(r[0]), r[1], r[0].tobytes()))  # the order of arrival may differ between runs
        for epoch in range(s.epochs if seen else 0):
            for k in np.random.Generator(np.random.PCG64([s.seed, epoch])).permutation(len(seen)).tolist():
                model.learn(*seen[k])
        w = model.weights(np.arange(bias + 1))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at]), pa.array(np.full(len(at), bool(seen)))], ["at", "w", "used"])

    # copies of a text are dealt apart, by the id of their row
    dealt = rows.withColumn("label", F.col("label").cast("double")).repartition(max(1, -(-count // s.shard_rows)), F.xxhash64(rows.columns[-1], F.lit(s.seed)))
    shares = dealt.select("text", "label")
    # tasks that trained all have a bias; they are what the average is over
    parts = written(shares.mapInArrow(train, "at bigint, w double, used boolean"), "weights")
    trained = max(1, parts.filter(F.col("at") == bias).count())
    table = parts.groupBy("at").agg((F.sum("w") / trained).alias("w")).orderBy("at").toArrow()
    return table["at"].to_numpy(), table["w"].to_numpy()


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str, text_col: str, bits: int) -> DataFrame:
    """(id, score) for every row, by one pass with the broadcast weights (at most ``2 ** bits + 1`` of them)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = shared.value
        dense = np.zeros((1 << bits) + 1, np.float32)
        dense[at] = w
        bias = float(dense[-1])
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for a, b, data, offsets in _text.pieces(batch.column(1)):
                pairs = _distinct(data, offsets, bits, dense)
                total[a:b] = np.bincount(pairs >> 40, dense[pairs & ((1 << 40) - 1)], b - a)
            out = 1.0 / (1.0 + np.exp(-np.clip(total + bias, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], [id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double")


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Rows set aside: crc32 of the id as text leaves the remainder ``part``; a null id is not set aside."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, settings: Settings = Settings(), broadcast_rows: int = 2_000_000) -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``score`` and ``predicted`` (1 from ``threshold`` on).

    Labels are learned only from rows that are not held out (crc32 of the id as text, modulo 4, is 2) and that
    have a label; of more than ``sample_rows`` labelled rows, a share chosen by the hash of the id is used. A
    feature counts once per text. Null and empty texts have the bias alone; without any label every score is 0.5.
    Labels that repeat are all used, null labels are not; other columns are ignored.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, 4, 2))
    n = known.count()
    if n > settings.sample_rows:
        known = known.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(settings.seed)), F.lit(1_000_000)) < int(1_000_000 * settings.sample_rows / n))
    known = known.select(F.col(id_col).alias("_id"), F.col(label_col).alias("label"))
    known = F.broadcast(known) if min(n, settings.sample_rows) <= broadcast_rows else known
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text"))
    train = texts.join(known, F.col("_doc") == F.col("_id")).select("text", "label", "_id")
    scored = score(docs, fit(train, min(n, settings.sample_rows), settings), id_col, text_col, settings.bits)
    return scored.select(id_col, held_out(id_col, 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

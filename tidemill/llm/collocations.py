"""Phrase collocation mining by partitioning: shards list what may be frequent, all documents then count it exactly."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import written
from ._text import hashed_words, mix, word_hashes

_U = np.uint64
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True
_STEP = _U(0xD6E8FEB86659FD93)
_SECTION = 32_768  # bits of a row of Spark's bitmap_construct_agg


@dataclass
class Shard:
    """Words of some texts in order: where they begin and end in ``data`` (lower case), hashes, a number that neighbours of one piece share, languages, and whether they are new (not carried over from the part before of a long text)."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    piece: np.ndarray
    lang: np.ndarray
    new: np.ndarray
    langs: list[str]

    def phrases(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all phrases of ``n`` words that end in a new word, and 64-bit hashes of phrase and language."""
        m = len(self.starts) - n + 1
        if m <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero((self.piece[:m] == self.piece[n - 1 :]) & self.new[n - 1 :])
        own = np.array([hash_text(x) for x in self.langs], np.uint64)
        out = own[self.lang[at]]
        for j in range(n):
            out *= _STEP
            out += self.hashes[at + j]
        return at, mix(out + _U(n))

    def text(self, at: int, n: int) -> str:
        return b" ".join(self.data[a:b] for a, b in zip(self.starts[at : at + n].tolist(), self.ends[at : at + n].tolist())).decode("utf-8", "replace")


def hash_text(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")


def _parts(text: bytes, most: int) -> Iterator[tuple[bytes, int]]:
    """A long text in parts cut between words, and how many words at the beginning of each the part before had too: the last three."""
    a, carried, n = 0, 0, len(text)
    while True:
        b = min(n, a + most)
        while b < n:
            gap = np.flatnonzero(_GAP[np.frombuffer(text, np.uint8, min(1 << 16, n - b), b)])
            if len(gap):
                b += int(gap[0])
                break
            b = min(n, b + (1 << 16))
        yield text[a:b], carried
        if b >= n:
            return
        back, look, carried = b, 1 << 12, 0
        while True:
            low = max(a, b - look)
            inside = ~_GAP[np.frombuffer(text, np.uint8, b - low, low)]
            begins = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1 + low
            if len(begins) >= 3 or low == a:
                break
            look *= 8
        if len(begins):
            back, carried = int(begins[-3:][0]), len(begins[-3:])
        if low == a and len(inside) and inside[0] and len(begins) < 3 and carried < 3:  # the part's first word is one of the last three
            back, carried, most = a, len(begins) + 1, 2 * most
        a = back


def _words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and pieces of the words of some bytes."""
    raw = np.frombuffer(text, np.uint8)
    inside = np.concatenate(([False], ~_GAP[raw], [False]))
    change = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = change[::2], change[1::2]
    return starts, ends, np.searchsorted(np.flatnonzero(_BREAK[raw]), starts)


def shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Shard]:
    """The (lang, text) rows of a task in shards of about ``most`` bytes; a longer text is several shards. A word takes 28 bytes in a shard."""
    held: list[tuple] = []
    size, langs = 0, {}

    def closed() -> Shard:
        data = b"\n".join(part for _, part, _ in held)  # a line end, so no piece goes on in the next text
        begins = np.cumsum([0, *(len(part) + 1 for _, part, _ in held)])
        starts, ends, piece = _words(data)
        raw = np.frombuffer(data, np.uint8)
        hashes = np.concatenate([_hashes(raw[a:b], s, e) for a, b, s, e in _runs(starts, ends)] or [np.empty(0, np.uint64)])
        first = np.searchsorted(starts, begins)
        lang = np.repeat(np.array([x for x, _, _ in held], np.int32), np.diff(first))
        new = np.ones(len(starts), bool)
        for k, (_, _, carried) in enumerate(held):
            new[first[k] : first[k] + carried] = False
        return Shard(data, starts.astype(np.uint32), ends.astype(np.uint32), hashes, piece.astype(np.uint32), lang, new, list(langs))

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            for part, carried in _parts(raw.lower(), most):
                if held and size + len(part) > most:
                    yield closed()
                    held, size, langs = [], 0, {}
                held.append((langs.setdefault(lang, len(langs)), part, carried))
                size += len(part) + 16
    if held:
        yield closed()


def _runs(starts: np.ndarray, ends: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Words in runs of about ``most`` bytes, for hashing: (first byte, end, starts, ends), relative to the first."""
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + most, "right")))
        yield int(starts[a]), int(ends[b - 1]), starts[a:b] - starts[a], ends[a:b] - starts[a]
        a = b


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return word_hashes(raw, starts, ends) if len(raw) <= 1 << 20 else hashed_words(raw, np.array([0, len(raw)]))[0]  # a very long word is a run alone


def _places(hashes: np.ndarray, sections: int) -> np.ndarray:
    """The leading bits of hashes by which phrases are told apart among shards: 32 in each of so many sections, a power of 2."""
    return hashes >> _U(33 - sections.bit_length())


class Filter:
    """A bitmap of the places of hashes that may be frequent; what it lacks isn't."""

    def __init__(self, places: DataFrame, sections: int, bits: int):
        """Of rows (at, lacks): Spark unites the bits ``at``, ``bits`` / 8 bytes at most reach the driver; ``lacks`` of the rows without is what the sums behind them may lack."""
        at = F.col("at") + 1
        section, place = F.coalesce(F.bitmap_bucket_number(at), F.lit(0)), F.coalesce(F.bitmap_bit_position(at), F.lit(0))
        found = places.groupBy(section.alias("section")).agg(F.bitmap_construct_agg(place).alias("bits"), F.max("lacks").alias("lacks")).collect()
        self.lacks, self.sections = max((r.lacks or 0 for r in found), default=0), sections
        self.bits = np.zeros(bits // 8, np.uint8)
        for r in found:
            if r.section:
                low = (r.section - 1) * (_SECTION // 8)
                self.bits[low : low + _SECTION // 8] = np.frombuffer(r.bits, np.uint8)[: len(self.bits) - low]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (mix(_places(hashes, self.sections)) % _U(len(self.bits) * 8)).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _shorter(shard: Shard, n: int, filter_: Filter) -> tuple[np.ndarray, np.ndarray]:
    """``phrases(n)`` of which both phrases of ``n`` - 1 words within may be frequent."""
    at, hashes = shard.phrases(n)
    whole = Shard(shard.data, shard.starts, shard.ends, shard.hashes, shard.piece, shard.lang, np.ones(len(shard.new), bool), shard.langs)
    first, own = whole.phrases(n - 1)
    ok = np.zeros(len(shard.starts) + 1, bool)
    ok[first] = filter_.has(own)
    keep = ok[at] & ok[at + 1]
    return at[keep], hashes[keep]


def _packed(values: np.ndarray) -> bytes:
    """Small numbers as the planes of their bytes, of which most are zero and compress well."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places within a section, and counts."""
    steps, counts = (np.ascontiguousarray(x.T).view("<u4").ravel() for x in np.frombuffer(blob, np.uint8).reshape(2, 4, -1))
    return np.cumsum(steps, dtype=np.uint64), counts.astype(np.int64)


def _mined(docs: DataFrame, n: int, shorter, support: int, total: int, shard_bytes: int, sections: int) -> DataFrame:  # noqa: ANN001
    """(section, seen): the phrases of ``n`` words that are frequent in a shard, at as large a part of ``support`` as the shard has of all words, with their counts beyond what a shard may leave out. Section -1 says how much that is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, shard_bytes):
            _, hashes = _shorter(shard, n, shorter.value)
            found, count = np.unique(_places(hashes, sections), return_counts=True)
            # the parts sum to the support over all shards, so what is below its part everywhere is below the support; floats only lower it
            low = max(1, math.ceil(support * (int(shard.new.sum()) / total) * (1 - 1e-9)))
            found, count = found[count >= low], count[count >= low] - (low - 1)
            cut = np.searchsorted(found, np.arange(sections + 1, dtype=np.uint64) << _U(32))
            own, blobs = [-1], [_packed(np.array([0])) + _packed(np.array([low - 1]))]
            for k in np.flatnonzero(np.diff(cut)).tolist():
                part = found[cut[k] : cut[k + 1]] & _U(0xFFFFFFFF)
                own.append(k)
                blobs.append(_packed(np.diff(part, prepend=_U(0))) + _packed(count[cut[k] : cut[k + 1]]))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(blobs, pa.binary())], names=["section", "seen"])

    return docs.mapInArrow(run, "section int, seen binary")


def _frequent(mined: DataFrame, support: int, sections: int, bits: int) -> Filter:
    """What may be frequent: the shards' lists are added up section by section. A sum may lack what shards have left out."""

    def added(lacks: int):  # noqa: ANN202
        def run(rows: pa.Table) -> pa.Table:
            section = rows["section"][0].as_py()
            lists = [_unpacked(blob.as_py()) for blob in rows["seen"]]
            if section < 0:
                return pa.table({"at": pa.nulls(1, pa.int64()), "lacks": pa.array([int(sum(c.sum() for _, c in lists))], pa.int64())})
            place, count = (np.concatenate(x) for x in zip(*lists))
            order = np.argsort(place)
            place, first = np.unique(place[order], return_index=True)
            near = place[np.add.reduceat(count[order], first) + lacks >= support] | _U(section << 32)
            at = (mix(near) % _U(bits)).astype(np.int64)
            return pa.table({"at": at, "lacks": pa.nulls(len(at), pa.int64())})

        return run

    lacks = 0
    while True:
        out = Filter(mined.groupBy("section").applyInArrow(added(lacks), "at bigint, lacks bigint"), sections, bits)
        if out.lacks <= lacks:
            return out
        lacks = out.lacks  # few shards, so a small table: once more with what they left out


_COUNTED = "lang string, words int, phrase string, n bigint"


def _counted(docs: DataFrame, wanted: dict, shard_bytes: int) -> DataFrame:
    """(lang, words, phrase, f): how often all phrases that ``wanted`` has are found: {number of words: shared filter, or None for all}."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, shard_bytes):
            for n, own in wanted.items():
                at, hashes = shard.phrases(n)
                if own is not None:
                    keep = own.value.has(hashes)
                    at, hashes = at[keep], hashes[keep]
                _, first, count = np.unique(hashes, return_index=True, return_counts=True)
                for a in range(0, len(first), 50_000):
                    here = at[first[a : a + 50_000]]
                    texts = [shard.text(k, n) for k in here.tolist()]
                    langs = [shard.langs[k] for k in shard.lang[here].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array([n] * len(here), pa.int32()), pa.array(texts, pa.string()), pa.array(count[a : a + 50_000].astype(np.int64))], names=["lang", "words", "phrase", "n"])

    return docs.mapInArrow(run, _COUNTED).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("f"))


def _words_filter(words: DataFrame, sections: int, bits: int) -> Filter:
    """A filter of the words in (lang, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in shards(iter([batch]), 1 << 22):
                at = (mix(_places(shard.phrases(1)[1], sections)) % _U(bits)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.nulls(len(at), pa.int64())], names=["at", "lacks"])

    return Filter(words.select("lang", F.col("phrase").alias("text")).mapInArrow(run, "at bigint, lacks bigint"), sections, bits)


def phrase_counts(docs: DataFrame, support: int = 30, longest: int = 4, text_col: str = "text", lang_col: str = "lang", shard_bytes: int = 1 << 23, filter_bits: int = 1 << 27, section_words: int = 1 << 21) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of all phrases of up to ``longest`` words that occur ``support`` times or more, and (lang, n), all words.

    Length by length each shard lists its phrases that are frequent at the support's share for its size and whose shorter
    phrases may be frequent everywhere; Spark adds the lists up, in sections of about ``section_words`` entries, and unites what may
    be frequent in a bitmap of ``filter_bits``.
    Then all shards count what the bitmaps have, with its text, and the sums decide. A full bitmap only lets more
    phrases be counted. Where a shard's share of the support is below 1, as it is with more shards than ``support``, it lists all its
    phrases with frequent parts, and nothing is left out of the sums. A task holds one shard at a time. Within a shard
    phrases are told apart by 64-bit hashes.
    """
    share = docs.sparkSession.sparkContext.broadcast
    docs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = written(_counted(docs, {1: None}, shard_bytes), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    total = words.agg(F.sum("f")).first()[0] or 1
    frequent = words.filter(F.col("f") >= support)
    sections = 1 << min(16, max(0, math.ceil(math.log2(total / section_words))))
    shorter, wanted = share(_words_filter(frequent, sections, filter_bits)), {}
    for n in range(2, longest + 1):
        shorter = wanted[n] = share(_frequent(_mined(docs, n, shorter, support, total, shard_bytes, sections), support, sections, filter_bits))
    found = written(_counted(docs, wanted, shard_bytes).filter(F.col("f") >= support), "phrases")
    return frequent.unionByName(found), totals


def collocations(docs: DataFrame, support: int = 30, longest: int = 4, keep: int = 2_000, covered: tuple[int, int] = (80, 100), **options) -> DataFrame:  # noqa: ANN003
    """The ``keep`` first collocations of each language: lang, ``rank``, ``phrase``, ``a`` (its occurrences), ``l`` and ``r`` (those of the parts of its weakest cut), ``n`` (words of the language), ``score``.

    Texts are lower-cased (A-Z) and split at ``.,;:!?`` and line ends into pieces, pieces at blanks and tabs into
    words. A phrase of 2 to ``longest`` words with a >= ``support`` is a candidate; a cut in two gives floor(2000000 a / (l + r)), the
    least of its cuts (the first of equals) is its score. Candidates within a longer one that has ``covered``
    (80 of 100) of their occurrences are dropped. Order: score and a descending, phrase ascending by bytes.

    Null texts are empty, null languages ``und``; repeated rows count again; other columns are ignored; without
    candidates there are no rows. ``options`` are those of ``phrase_counts``.
    """
    counts, totals = phrase_counts(docs, support, longest, **options)
    words = F.split("phrase", " ")
    candidates = counts.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), words.alias("w"))
    joined = lambda first, size: F.array_join(F.slice("w", first, size), " ")
    cuts = candidates.select("lang", "phrase", "words", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("head"), joined(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    part = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    score = F.expr("(cast(a as decimal(19,0)) * 2000000BD) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), weakest.alias("_w"))

    inner = F.explode(F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(w, i, m), ' '))))")).alias("phrase")
    within = candidates.filter("words > 2").select("lang", inner, F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(within, ["lang", "phrase"], "left")
    enough = F.expr(f"cast(longer as decimal(19,0)) * {covered[1]}BD >= cast(a as decimal(19,0)) * {covered[0]}BD")
    kept = kept.filter(~F.coalesce(enough, F.lit(False)))
    order = Window.partitionBy("lang").orderBy(F.desc("_w.score"), F.desc("a"), "phrase")
    first = kept.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= keep)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "_w.l", "_w.r", "n", "_w.score")


def oracle_sql() -> str:
    """The registered query in DuckDB SQL."""
    grams = " union all ".join(f"select lang, array_to_string(w[i:i + {m - 1}], ' ') as phrase, {m} as words from (select lang, w, unnest(range(1, len(w) - {m - 2})) as i from pieces where len(w) >= {m})" for m in (1, 2, 3, 4))
    return rf"""
      with texts as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
        pieces as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as p from texts)),
        total as (select lang, sum(len(w))::bigint as n from pieces group by 1),
        f as (select lang, phrase, words, count(*) as f from ({grams}) group by 1, 2, 3 having count(*) >= 30),
        cand as (select lang, phrase, words, f as a, string_split(phrase, ' ') as w from f where words > 1),
        cut as (select *, unnest(range(1, words)) as k from cand),
        cuts as (select c.lang, c.phrase, c.a, c.k, h.f as l, t.f as r, ((2000000::hugeint * c.a) // (h.f + t.f))::bigint as score from cut c
          join f h on h.lang = c.lang and h.phrase = array_to_string(c.w[1:c.k], ' ') join f t on t.lang = c.lang and t.phrase = array_to_string(c.w[c.k + 1:], ' ')),
        scored as (select lang, phrase, a, l, r, score from cuts qualify row_number() over (partition by lang, phrase order by score, k) = 1),
        inside as (select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, max(a) as longer from (select *, unnest(range(1, words - m + 2)) as i from (select *, unnest(range(2, words)) as m from cand where words > 2)) group by 1, 2),
        kept as (select s.* from scored s left join inside i using (lang, phrase) where i.longer is null or 100::hugeint * i.longer < 80::hugeint * s.a)
      select * from (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from kept join total using (lang)) where rank <= 2000"""

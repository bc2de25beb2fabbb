"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities."""

from __future__ import annotations

import base64
import json
import math
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CHUNK = 1 << 19
#: Between a character that is no white space by any definition and white space.
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \n])")
#: White space so long that the faster library may run out of stack.
_RUN = re.compile(r"\s{100000}")


def cut_safely(text: str, most: int) -> Iterator[str]:
    """``text`` in chunks of about ``most`` characters that begin with white space after another character, where a pre-token ends in any case."""
    a = 0
    while len(text) - a > most and (m := _CUT.search(text, a + most)):
        yield text[a : m.end()]
        a = m.end()
    yield text[a:]


class Tokenizer:
    """Token ids of a byte-level BPE vocabulary file of the ``tokenizers`` library, with no special tokens added.

    Texts without an added token's string are encoded with the file's own ranks by a faster library, which gives
    the same ids for byte-level BPE; all others, and vocabularies of another kind, by ``tokenizers`` itself. The
    faster way goes by chunks of about ``_CHUNK`` characters; a chunk that it can't take, such as a very long run
    of white space, goes to ``tokenizers``.
    """

    def __init__(self, path: str):
        import tokenizers

        self.full = tokenizers.Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = self._fast(spec)

    @staticmethod
    def _fast(spec: dict):  # noqa: ANN205
        import tiktoken

        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model", {})
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space", True) and not spec.get("normalizer")
        if not plain or model.get("type") != "BPE":
            return None
        byte = _byte_alphabet()
        vocab = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if all(c in byte for c in token)}
        # Fixed value: the pattern of byte-level BPE pre-tokenisers.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        vocab = {k: v for k, v in vocab.items() if v < 256 or len(k) > 1}
        merges = model["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        in_order = all(model["vocab"][a + b] == 256 + k for k, (a, b) in enumerate(pairs))
        if not in_order or len(vocab) != 256 + len(pairs):
            return None
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocab, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(t in text for t in self.added):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self._chunk(text) if len(text) <= _CHUNK else np.concatenate([self._chunk(c) for c in cut_safely(text, _CHUNK)])

    def _chunk(self, text: str) -> np.ndarray:
        if len(text) < 100_000 or not _RUN.search(text):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except ValueError:  # its pattern matcher ran out of stack
                pass
        return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4")


def _byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies: a byte's own, or the next from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One per Python worker."""
    return Tokenizer(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", most: int = 1024, end_id: int = 0) -> DataFrame:
    """Every document's ids, followed by ``end_id``, cut after each ``most``: one row per piece.

    Columns: id, ``start``, ``length``, ``ids`` (binary, little-endian unsigned 32 bits each), ``doc_tokens`` and
    ``deal``, a number that tells documents of one id apart, and copies of one within a partition. A
    null or empty text has ``end_id`` alone. A text of any length is encoded chunk by chunk. Ids are passed on as
    they are, null or repeated. The file of the tokenizer has to be readable under the same path on every executor.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_path).ids
        end = np.array([end_id], "<u4").tobytes()
        names = [id_col, "start", "length", "ids", "doc_tokens", "deal"]
        part, copies = TaskContext.get().partitionId(), {}
        for batch in batches:
            rows: list[tuple[int, int, int, bytes, int, int]] = []
            held = 0
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py()
                raw = (encode(text).tobytes() if text else b"") + end
                n, deal = len(raw) // 4, zlib.crc32(raw)
                key = batch.column(0)[k].as_py(), deal
                if again := copies.get(key, 0):
                    deal = zlib.crc32(b"%d %d" % (part, again), deal)
                copies[key] = again + 1
                rows += [(k, a, min(most, n - a), raw[4 * a : 4 * (a + most)], n, deal) for a in range(0, n, most)]
                held += len(raw)
                if held > 1 << 23 or k == batch.num_rows - 1:
                    at, start, length, ids, total, dealt = zip(*rows)
                    columns = [batch.column(0).take(pa.array(at)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64()), pa.array(dealt, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names)
                    rows, held = [], 0

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(cut, f"`{id_col}` {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, deal bigint")


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, lengths taken from the largest on, each into the first bin with room.

    The bins' free room is the leaves of a tournament tree whose inner nodes hold the larger of their children, so
    the first bin with room is found from the root down in logarithmic time.
    """
    n = len(lengths)
    width = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * width)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        at = 1
        while at < width:
            at *= 2
            if tree[at] < need:
                at += 1
        bins[k], offsets[k] = at - width, capacity - tree[at]
        tree[at] -= need
        at //= 2
        while at:
            top = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == top:
                break
            tree[at] = top
            at //= 2
    return bins, offsets


def _pack_group(most: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        group = key[0].as_py()
        rows = rows.sort_by([("length", "descending"), ("_order", "ascending"), ("start", "ascending")])
        lengths = rows["length"].to_numpy()
        bins, offsets = first_fit_decreasing(lengths, most)
        kept = [c for c in rows.column_names if c not in ("_group", "_order")]
        return rows.select(kept).append_column("sequence_id", pa.array((group << 32) + bins)).append_column("offset", pa.array(offsets))

    return pack


def place_pieces(pieces: DataFrame, documents: int, order: list[str], most: int = 1024, group_documents: int = 4096, seed: int = 5) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: where each goes, in sequences of at most ``most`` tokens.

    Documents are dealt by a hash of the columns ``order`` into random groups of about ``group_documents``; each group
    packs its pieces by first-fit decreasing on its own. A piece of ``most`` tokens fills a sequence. The column
    ``deal`` is left out.
    """
    groups = max(1, math.ceil(documents / group_documents))
    dealt = pieces.withColumn("_order", F.xxhash64(*order)).drop("deal")
    dealt = dealt.withColumn("_group", F.pmod(F.xxhash64("_order", F.lit(seed)), F.lit(groups)).cast("bigint"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "deal") + ", sequence_id bigint, offset bigint"
    return dealt.groupBy("_group").applyInArrow(_pack_group(most), schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", most: int = 1024, end_id: int = 0, group_documents: int = 4096) -> DataFrame:
    """All documents as token sequences of at most ``most`` tokens: a row per piece, as ``token_pieces`` plus its place.

    Rows that repeat an id, or have none, each get pieces of their own and are dealt apart. A long text has as many
    pieces as it needs, in one group. An empty table gives no rows; other columns are ignored.
    """
    cut = token_pieces(docs, tokenizer_path, id_col, text_col, most, end_id)
    return place_pieces(cut, docs.count(), [id_col, "deal"], most, group_documents)

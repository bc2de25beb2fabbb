"""Texts beyond the size of a part give what they give as a whole."""

import random
import resource

import numpy as np

from tidemill.llm import _text, jaccard, ppm, toxicity


def whole(text):
    data = np.frombuffer(text, np.uint8)
    return data, np.array([0, len(data)])


def test_hashed_words_of_long_texts():
    rng = random.Random(1)
    for text in (b" ".join(rng.choice([b"a", b"bcd", b"efgh" * 9]) for _ in range(900_000)), b"x" * 9_000_000 + b" y z", b" " * 9_000_000 + b"q", b"a b " + b"z" * 17_500_000 + b" c " * 10, b"\n" + b"w" * 30_000_000):
        data, offsets = whole(text)
        starts, ends, first = _text.words(data, offsets)
        want = _text.word_hashes(data, starts, ends)
        got, place = _text.hashed_words(data, offsets)
        assert np.array_equal(got, want) and place.tolist() == first.tolist()


def test_parts_carry_words():
    text = b" ".join(b"w%d" % (i % 5000) for i in range(2_000_000))
    data, offsets = whole(text)
    row, feature = toxicity._features(data, offsets, 20)
    assert np.array_equal(toxicity._distinct(data, offsets, 20), np.unique(feature))
    parts = list(_text.long_parts(data, 2, 1 << 20))
    assert len(parts) > 5 and all(parts[k + 1].tobytes().split()[:2] == p.tobytes().split()[-2:] for k, p in enumerate(parts[:-1]))


def test_grams_of_long_texts():
    data, offsets = whole(bytes(random.Random(2).choices(range(97, 110), k=9_000_000)))
    want, _ = ppm._grams(data, offsets, 6)
    assert np.array_equal(np.concatenate([g for g, _ in ppm._gram_parts(data, offsets, 6)]), want)


def test_memory_of_a_hundred_megabytes():
    import pyarrow as pa

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    column = pa.array([" ".join(f"word{i % 9973}" for i in range(10_500_000))])
    for _, sets in jaccard._shingle_sets(column, 5):
        assert len(sets[0]) == 9973
    data, offsets = _text.buffers(column)
    assert len(toxicity._distinct(data, offsets, 22, np.ones(1 << 22, np.float32))) > 9973
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10 < 2500

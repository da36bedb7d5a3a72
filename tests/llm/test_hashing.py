"""Hashes of words and windows: no sequences that always meet, and plain arithmetic."""

import random

import numpy as np

from codeloom.llm import hashing, ngram_join, substring_dedup

from . import brute


def thue_morse(n, a, b):
    return [b if bin(i).count("1") % 2 else a for i in range(n)]


def texts_as_bytes(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def hashed(text):
    data, offsets = texts_as_bytes([text])
    starts, ends, _ = hashing.words(data, offsets)
    return hashing.word_hashes(data, starts, ends)


def test_arithmetic():
    rng = random.Random(1)
    a = [rng.randrange(hashing.PRIME) for _ in range(500)] + [0, 1, hashing.PRIME - 1, hashing.PRIME - 1]
    b = [rng.randrange(hashing.PRIME) for _ in range(500)] + [hashing.PRIME - 1, hashing.PRIME - 1, hashing.PRIME - 1, 2]
    got = hashing.times(np.array(a, np.uint64), np.array(b, np.uint64))
    assert got.tolist() == [x * y % hashing.PRIME for x, y in zip(a, b, strict=True)]
    sums = hashing._running(np.array(a, np.uint64))
    assert sums.tolist() == [sum(a[:i]) % hashing.PRIME for i in range(len(a) + 1)]
    assert hashing._powers(hashing.OTHER, 40).tolist() == [pow(hashing.OTHER, i, hashing.PRIME) for i in range(40)]


def test_windows_and_ranges_agree():
    h = hashed("a b c a b c d é 😀 a b c")
    for base in (hashing.FIRST, hashing.OTHER):
        w = hashing.window_hashes(h, 3, base)
        assert w[0] == w[3] == w[9] and len(set(w.tolist())) == 8
        r = hashing.range_hashes(h, np.array([0, 3, 9, 0]), np.array([3, 6, 12, 2]), base)
        assert r[0] == r[1] == r[2] != r[3]


def test_words_of_thue_and_morse():
    one, two = "".join(thue_morse(1024, "a", "b")), "".join(thue_morse(1024, "b", "a"))
    h = hashed(f"{one} {two} {one}")
    assert (h[:, 0] == h[:, 2]).all() and (h[:, 0] != h[:, 1]).all()


def test_sequences_of_thue_and_morse():
    h = hashed(" ".join(thue_morse(2048, "a", "b") + thue_morse(2048, "b", "a")))
    for base in (hashing.FIRST, hashing.OTHER):
        whole = hashing.range_hashes(h, np.array([0, 2048]), np.array([2048, 4096]), base)
        assert whole[0] != whole[1]


def test_texts_that_differ_in_such_a_word(spark):
    one, two = "".join(thue_morse(1024, "a", "b")), "".join(thue_morse(1024, "b", "a"))
    start = " ".join(f"w{i}" for i in range(34))
    texts = [f"{start} {one}", f"{start} {two}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted(tuple(r) for r in substring_dedup.digest(docs).collect())
    assert [r[1:] for r in got] == brute.without_repeats(texts) and all(r[2] == 0 for r in got)
    joined = {r["doc_id"]: r for r in ngram_join.join(docs).collect()}
    assert joined[0]["text_id"] != joined[1]["text_id"] and joined[0]["n_text_links"] == joined[1]["n_text_links"] == 1


def test_long_texts_of_thue_and_morse(spark):
    """Blocks of very many words, alike but for the turn."""
    texts = [" ".join(thue_morse(4096, "a", "b")), " ".join(thue_morse(4096, "b", "a")), "c " * 34 + "d"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [tuple(r[1:]) for r in sorted(substring_dedup.digest(docs).collect())] == brute.without_repeats(texts)

"""Substring dedup against brute force: frequent prefixes, longer prefixes, null and repeated ids."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import common, substring


def expected(rows, window=35):
    """(doc_id, n_words, n_removed, kept) of each row."""
    texts = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (k, _), w in zip(rows, texts, strict=True):
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                keep[i : i + window] = [False] * window
        out.append((k, len(w), len(w) - sum(keep), b" ".join(x for x, y in zip(w, keep, strict=True) if y).decode()))
    return out


def found(df, **more):
    return [(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring.strip(df, **more).collect()]


def same(a, b):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    return sorted(a, key=key) == sorted(b, key=key)


def corpus():
    """Passages of many lengths in many contexts, copies, near copies and a short frequent line."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    passages = [some(n) for n in (20, 34, 35, 36, 50, 90)]
    line = some(12)
    base = some(150)
    out = []
    for i in range(140):
        own = some(rng.randrange(60))
        for _ in range(rng.randrange(3)):
            own += rng.choice(passages) + some(rng.randrange(20))
        own += line + some(30)
        if i % 7 == 0:
            own = list(base)
            own[rng.randrange(150)] = f"new{i}"
        out.append((i, " ".join(own)))
    out += [(200 + i, out[i][1]) for i in range(0, 30, 3)] + [(300, "abc " * 300), (301, None), (302, "")]
    return out


@pytest.mark.parametrize("most", [1 << 19, 200])
def test_against_brute_force(spark, most):
    """With groups of 200 words at most, prefixes must be made longer up to whole windows."""
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert same(found(df, most=most), expected(rows))


@pytest.mark.parametrize("most", [1 << 19, 200])
def test_nothing_is_frequent(spark, monkeypatch, most):
    """All spans take the way of those that the sample doesn't show."""
    monkeypatch.setattr(substring, "hot_keys", lambda docs, keys: np.zeros(0, np.uint64))
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert same(found(df, most=most), expected(rows))


def test_null_and_repeated_ids(spark):
    rng = random.Random(3)
    a, b, c = (" ".join(rng.choice("abcdefghij") * 2 + str(rng.randrange(50)) for _ in range(60)) for _ in range(3))
    rows = [(1, a), (2, a + " and more"), (1, "short text"), (1, b), (None, b), (None, "x y"), (None, c), (5, c), (6, c), (7, None), (7, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string").repartition(3)
    out = substring.strip(df)
    assert out.columns == ["doc_id", "text", *substring.ADDED]
    assert same(found(df), expected(rows))


def test_longer_prefixes_hold_every_window(spark):
    """Each window of a run stays in one part of it, under a prefix that it holds."""
    rng = np.random.default_rng(2)
    span = rng.integers(1, 1 << 60, 50).astype(np.uint64)
    rows = spark.createDataFrame([(1, 9, 100, 1, 20, bytearray(span.tobytes()))], substring.OPENED)
    for length in (8, 16):
        rows = rows.mapInArrow(lambda batches, n=length: substring.longer(batches, n, 35, 8, False), substring.OPENED)
        parts = rows.collect()
        starts = sorted(r["s"] + i for r in parts for i in range(len(r["span"]) // 8 - 34))
        assert starts == list(range(100, 116))
        for r in parts:
            many = len(r["span"]) // 8 - 34
            assert r["o"] >= many - 1 and r["o"] + length + 8 <= 35
            assert r["span"] == span[r["s"] - 100 : r["s"] - 100 + many + 34].tobytes()
    last = rows.mapInArrow(lambda batches: substring.longer(batches, 24, 35, 8, True), substring.OPENED).collect()
    assert sorted(r["s"] for r in last) == list(range(100, 116)) and len({r["k"] for r in last}) == 16 and not any(r["span"] for r in last)


def test_leaves():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    of, place, times = substring.leaves([x, x[5:45], np.append(x[50:], x[:35])], 35)
    got = {(a, b): t for a, b, t in zip(of.tolist(), place.tolist(), times.tolist(), strict=True)}
    assert got == {(0, i): 1 + (5 <= i <= 10) + (i == 0) for i in range(26)} | {(1, i): 2 for i in range(6)} | {(2, i): 1 + (i == 10) for i in range(11)}


def test_joined_ranges():
    d, a, b = substring.joined_ranges(np.array([2, 1, 1, 1, 1]), np.array([0, 10, 0, 3, 30]), np.array([5, 20, 5, 10, 40]))
    assert list(zip(d.tolist(), a.tolist(), b.tolist(), strict=True)) == [(1, 0, 20), (1, 30, 40), (2, 0, 5)]


def test_long_words_are_hashed_in_blocks():
    rng = np.random.default_rng(1)
    data = rng.integers(32, 60, 5000).astype(np.uint8)
    data[1000:1600] = 70
    start, end, hashes, _ = common.words(data, np.array([0, 2000, 5000]), False)
    for most in (7, 64, 100, 4999, 9000):
        assert (common.word_hashes(data, start, end, common.BYTE, most) == hashes).all()


def test_very_long_text(spark):
    rng = random.Random(6)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(400_000))
    rows = [(1, long), (2, " ".join(long.split()[200_000:200_050])), (3, "x" * 3_000_000 + " " + "y")]
    got = {r[0]: r[1:3] for r in found(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got == {1: (400_000, 50), 2: (50, 50), 3: (2, 0)}


def test_numbers_stay(spark):
    df = common.numbered(spark.range(100).repartition(7), "n")
    assert df.select(F.count_distinct("n")).first()[0] == 100
    assert {tuple(r) for r in df.collect()} == {tuple(r) for r in df.collect()}

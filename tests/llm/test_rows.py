"""Rows with null or repeated ids, other types, long texts and empty tables, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import caps, jaccard, topk

from .test_operators import shingles

RNG = random.Random(12)
WORDS = [f"v{i}" for i in range(300)]
BASE = [[RNG.choice(WORDS) for _ in range(n)] for n in (80, 120, 60)]


def near(words, edits):
    out = list(words)
    for _ in range(edits):
        out[RNG.randrange(len(out))] = RNG.choice(WORDS) + "x"
    return " ".join(out)


def odd_rows():
    a, b, c = (" ".join(w) for w in BASE)
    return [(5, a), (5, near(BASE[0], 1)), (5, b), (3, near(BASE[1], 2)), (None, a), (None, c), (None, near(BASE[2], 1)), (9, c + " end"), (2, "short"), (2, "short"), (None, "short"), (7, None), (7, ""), (None, None), (8, "one"), (6, " ".join(BASE[0] * 3000))]


def jaccard_rows(rows):
    """(doc_id, n_shingles, component_id) of each row, as a list; and the kept rows of each group."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    links = [(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets[:i]) if 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) > 0 and 100 * len(x & y) >= 75 * len(x | y)]
    for _ in rows:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    low = {}
    for (k, _), r in zip(rows, root, strict=True):
        low[r] = min([x for x in (low.get(r), k) if x is not None], default=None)
    return [(k, len(s), low[r]) for (k, _), s, r in zip(rows, sets, root, strict=True)], len(set(root)), low


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def test_jaccard_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, rep string").repartition(3)
    want, groups, low = jaccard_rows(rows)
    got = [tuple(r) for r in jaccard.jaccard_components(df).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    whole = [tuple(r) for r in jaccard.jaccard_components(df, miss=None).collect()]
    assert sorted(whole, key=key) == sorted(want, key=key)
    kept = jaccard.first_documents(df)
    assert kept.columns == ["doc_id", "text", "rep"]
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == groups and sorted(map(str, ids)) == sorted(map(str, low.values()))
    assert jaccard.first_documents(df.limit(0)).count() == 0


def test_jaccard_component_ids_may_be_any_integer(spark):
    rows = [(-5, "a b c d e f"), (-9, "a b c d e f"), (4, "a b c d e f")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert {tuple(r) for r in got} == {(k, 2, -9) for k, _ in rows}


def cluster(seed, n, width=64, spread=0.4):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 8, width))
    return base[rng.integers(0, len(base), n)] + rng.standard_normal((n, width)) * spread * rng.random((n, 1))


def test_caps_rows(spark):
    x = cluster(1, 160)
    rows = [(i, v.tolist(), "ab"[i % 2]) for i, v in enumerate(x)]
    rows += [(7, x[30].tolist(), "a"), (7, x[30].tolist(), "a"), (None, x[30].tolist(), "a"), (300, x[30].tolist(), None), (301, [], "a"), (302, x[4][:60].tolist(), "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = caps.near_vectors(df, 0.93).collect()
    assert len(got) == len(rows) and sum(r["vec_id"] == 7 for r in got) == 3
    fit = [(i, np.append(v, np.zeros(64 - len(v))), lab) for i, v, lab in rows if i is not None and lab and v]
    unit = np.array([v / np.linalg.norm(v) for _, v, _ in fit])
    same = np.array([[a[2] == b[2] for b in fit] for a in fit])
    link = (unit @ unit.T >= 0.93) & same
    np.fill_diagonal(link, False)
    assert 0.9 * link.sum() <= sum(r["n_links"] for r in got) <= link.sum()
    assert {(r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is None} == {(0, None, True)}
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
    assert by[30][0]["component_id"] == by[7][1]["component_id"] == min(r["component_id"] for r in by[7]) <= 7 and by[300][0]["n_links"] == 0


def test_caps_find_as_much_with_a_larger_codebook(spark):
    x = cluster(2, 800)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = int((unit @ unit.T >= 0.93).sum()) - len(x)
    big = caps.size_for(10_000_000)
    assert big.words > 2 * caps.WORDS and big.bound > 5 and caps.size_for(1000) == caps.Size(24, pytest.approx(4.0, abs=0.01), 14)
    for size in (None, big):
        found = caps.near_vectors(df, 0.93, size).agg(F.sum("n_links")).first()[0]
        assert 0.9 * links <= found <= links


def brute(fit, queries, k):
    return {(q, n, i, -s) for q in queries for n, (s, i) in enumerate(sorted((-int(fit[q] @ v), i) for i, v in fit.items() if i != q)[:k], 1)}


@pytest.mark.parametrize(("candidates", "queries"), [(64, 16), (37, 5), (8192, 2048)])
def test_top_k_in_cells_and_blocks(spark, monkeypatch, candidates, queries):
    monkeypatch.setattr(topk, "CANDIDATES", candidates)
    monkeypatch.setattr(topk, "QUERIES", queries)
    monkeypatch.setattr(topk, "PIVOTS", 5)
    x = np.concatenate([cluster(3, 300, 12, 0.05), np.ones((40, 12))])
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "vec_id long, embedding array<double>, known string").repartition(3)
    fit = {i: np.floor(64 * v) for i, v in enumerate(x)}
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 3 == 0, 7).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(fit, [i for i in fit if i % 3 == 0], 7)


def test_top_k_repeated_ids(spark):
    df = spark.createDataFrame([(1, [1.0]), (1, [2.0]), (2, [3.0]), (2, [1.0]), (None, [9.0]), (3, [])], "vec_id long, embedding array<double>")
    got = [tuple(r)[1:] for r in topk.top_k(df, F.col("vec_id") == 1, 3).collect()]
    assert sorted(got) == [(1, 2, 128 * 192), (2, 2, 64 * 192), (3, 2, 128 * 64)]


def test_highest_is_a_bound():
    rng = np.random.default_rng(5)
    rows, queries = rng.standard_normal((400, 6)) * 9, rng.standard_normal((50, 6)) * 9
    bound = topk.highest(queries, rows.min(0), rows.max(0), float(np.linalg.norm(rows, axis=1).max()))
    assert (bound >= (queries @ rows.T).max(1)).all()
    assert (bound <= np.maximum(queries, 0) @ rows.max(0) + np.minimum(queries, 0) @ rows.min(0) + 1e-3).all()


def test_search_stops_early():
    """Where few components carry most of the norm, most rows are never scored."""
    rng = np.random.default_rng(6)
    scale = 0.5 ** np.arange(32) * 6400
    rows, queries = np.floor(rng.standard_normal((4000, 32)) * scale), np.floor(rng.standard_normal((20, 32)) * scale)
    scored = []
    got = topk.search(np.arange(4000), rows, np.full(20, -1), queries, 10, None, scored)
    want = [(-1, i, -s) for q in queries for s, i in sorted((-int(q @ r), i) for i, r in enumerate(rows))[:10]]
    assert got == want and sum(scored) < 0.5 * rows.shape[0] * len(queries)
    far = topk.search(np.arange(4000), rows, np.full(20, -1), queries, 10, np.full(20, math.inf), again := [])
    assert not far and not again


def test_linked_sets_share_a_routed_ngram():
    """Of all pairs of random sets that link, over all shares of frequent n-grams and near the threshold."""
    rng = np.random.default_rng(9)
    linked = 0
    for _ in range(3000):
        common, extra = rng.integers(1, 40), rng.integers(0, 14, 2)
        pool = rng.permutation(400)
        sets = [np.sort(np.append(pool[:common], pool[100 * (i + 1) : 100 * (i + 1) + extra[i]])) for i in (0, 1)]
        frequent = rng.random(400) < rng.random()
        if 100 * common < 75 * (common + extra.sum()):
            continue
        linked += 1
        routed = []
        for x in sets:
            late = frequent[x]
            first, second = jaccard.prefix_sizes(len(x), int(late.sum()), 75, 100)
            routed.append((set(x[~late][:first].tolist()), set(x[late][:second].tolist()), int(late.sum()), len(x)))
        (a, fa, ra, na), (b, fb, rb, nb) = routed
        assert a & b or fa & fb and 175 * min(ra, rb) >= 75 * (na + nb)
    assert linked > 500


def test_search_is_exact_beyond_float64():
    rng = np.random.default_rng(10)
    rows, queries = np.floor(rng.standard_normal((300, 5)) * 2.0**28), np.floor(rng.standard_normal((7, 5)) * 2.0**28)
    rows[100:110] = rows[0]
    got = topk.search(np.arange(300), rows, np.arange(7), queries, 9)
    want = []
    for q, own in enumerate(queries):
        ranked = sorted((-sum(int(a) * int(b) for a, b in zip(own, r, strict=True)), i) for i, r in enumerate(rows) if i != q)
        want += [(q, i, -s) for s, i in ranked[:9]]
    assert got == want

"""Each operator against a brute-force version on small tables with nulls, empty texts, ties, copies
and extra columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import bpe, caps, jaccard, language, lm, packing, pii, quality, substring, topk

WORDS = [f"w{i}" for i in range(400)]


def documents():
    rng = random.Random(5)
    base = [" ".join(rng.choice(WORDS) for _ in range(n)) for n in (120, 90, 200, 60, 7, 4, 1)]
    edited = base[0].split()
    edited[60] = "Changed"
    passage = " ".join(rng.choice(WORDS) for _ in range(40))
    texts = [*base, " ".join(edited), base[0].upper(), base[3], None, "", " \n\t ", "one two three four", "ONE two\tthree four"]
    texts += [" ".join(rng.choice(WORDS) for _ in range(30)) + " " + passage + " " + " ".join(rng.choice(WORDS) for _ in range(30)) for _ in range(12)]
    texts += ["mail me: a.b@c-d.example.com, 10.0.0.256 or 10.0.0.25; card 4111 1111 1111 1111! phone +1 (212) 555-0100.", "日本 ½ don't <|endoftext|> \x85  x" * 3, "abc " * 90]
    return [(i, t, "x", 1.0) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, score string, n double"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard(docs, empty):
    sets = {k: shingles(t) for k, t, *_ in documents()}
    root = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {k: (len(s), root[k]) for k, s in sets.items()}
    assert jaccard.jaccard_components(empty).count() == 0


def test_jaccard_edited_copies(spark):
    """A large group of copies with up to nine edits, some edits shared: links near the threshold."""
    rng = random.Random(7)
    base = [rng.choice(WORDS) + str(i % 40) for i in range(150)]
    texts = []
    for i in range(160):
        own = list(texts[rng.randrange(len(texts))].split() if texts and i % 3 == 0 else base)
        for _ in range(rng.randrange(10)):
            own[rng.randrange(len(own))] = rng.choice(WORDS) + str(rng.randrange(4000))
        texts.append(" ".join(own))
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for _ in range(len(texts)):
        before = list(root)
        for a, x in enumerate(sets):
            for b in range(a):
                if root[a] != root[b] and 100 * len(x & sets[b]) >= 75 * len(x | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()}
    assert 1 < len(set(root)) < len(texts) and got == dict(enumerate(root))


def test_trie_links():
    rng = np.random.default_rng(1)
    own = np.unique(rng.integers(0, 300, 80).astype(np.uint64))
    sets = [np.unique(np.concatenate([own[rng.random(len(own)) < p], rng.integers(300, 400, k).astype(np.uint64)])) for p in (1, 0.9, 0.8, 0.5) for k in (0, 5, 15)]
    want = [100 * len(np.intersect1d(own, s)) >= 75 * len(np.union1d(own, s)) for s in sets]
    assert jaccard.trie_links(own, sets, 75, 100) == want


def test_substring(docs, empty):
    texts = {k: (t or "").encode().split() for k, t, *_ in documents()}
    seen = Counter(tuple(w[i : i + 35]) for w in texts.values() for i in range(len(w) - 34))
    want = {}
    for k, w in texts.items():
        keep = [True] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                keep[i : i + 35] = [False] * 35
        want[k] = (len(w), len(w) - sum(keep), b" ".join(x for x, y in zip(w, keep, strict=True) if y).decode())
    out = substring.strip(docs)
    assert out.columns == ["doc_id", "text", "score", "n", "n_words", "n_removed", "kept"]
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in out.collect()} == want
    assert substring.strip(empty).count() == 0


def test_bpe_round_trip(docs):
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path()
    own = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in bpe.encode(docs, path, tuple(bpe.OUTPUTS)).collect()}
    for k, t, *_ in documents():
        ids = own.encode(t or "", add_special_tokens=False).ids
        assert got[k]["ids"] == ids and got[k]["n_tokens"] == len(ids)
        assert got[k]["decoded"] == own.decode(ids, skip_special_tokens=False) == (t or "")
        assert got[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path, most = bpe.tokenizer_path(), 256
    own = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path, most).collect()
    for k, t, *_ in documents():
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 0]
        mine = sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["piece"])
        assert [r["start"] for r in mine] == [0, *np.cumsum([r["length"] for r in mine])[:-1].tolist()] and sum(r["length"] for r in mine) == len(ids)
        assert all(r["length"] == most for r in mine[1:])
        assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in mine)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own_bin in bins.values():
        at = 0
        for offset, length in sorted(own_bin):
            assert offset == at
            at += length
        assert at <= most
    assert packing.pack_documents(empty, path).count() == 0


def test_bin_completion():
    assert len(packing.pack([6, 5, 5, 4, 4, 3, 3], 10)) == 3
    sizes = [random.Random(3).randint(1, 100) for _ in range(60)]
    bins = packing.pack(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(60)) and all(sum(sizes[i] for i in b) <= 100 for b in bins)


def covered(small, bins):
    """Whether the pieces of small can be put into bins."""
    return not small or any(b >= small[0] and covered(small[1:], (*bins[:i], b - small[0], *bins[i + 1 :])) for i, b in enumerate(bins))


def fewest(sizes, room, bins=()):
    """Sequences of the best packing, by trying all."""
    if not sizes:
        return len(bins)
    tries = [fewest(sizes[1:], room, (*bins[:i], b + sizes[0], *bins[i + 1 :])) for i, b in enumerate(bins) if b + sizes[0] <= room]
    return min([*tries, fewest(sizes[1:], room, (*bins, sizes[0]))])


def test_fillings_are_the_undominated_ones():
    rng = random.Random(8)
    for _ in range(60):
        sizes, room = [rng.randint(1, 14) for _ in range(rng.randint(1, 7))], rng.randint(1, 20)
        every = {tuple(sorted(c, reverse=True)) for k in range(len(sizes) + 1) for c in itertools.combinations(sizes, k) if sum(c) <= room}
        left = packing.Left(sizes, 20)
        found = [(w, c) for w, c in left.fillings(room) if c is not None]
        got = [tuple(sorted((left.sizes[i] for i, times in c for _ in range(times)), reverse=True)) for _, c in found]
        assert len(got) == len(set(got)) and set(got) == {a for a in every if not any(a != b and covered(a, b) for b in every)}
        assert all(w == room - sum(g) for (w, _), g in zip(found, got, strict=True)) and [w for w, _ in found] == sorted(w for w, _ in found)


def test_packing_is_best_on_small_groups():
    rng = random.Random(9)
    for _ in range(150):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(0, 8))]
        best = fewest(sorted(sizes, reverse=True), 20)
        assert len(packing.pack(sizes, 20)) == best >= packing.least(sizes, 20)


def test_packing_joins_three_pieces():
    rng = random.Random(1)
    sizes = [rng.randint(400, 899) for _ in range(4096)]
    bins = packing.pack(sizes, 2048)
    assert sorted(i for b in bins for i in b) == list(range(4096)) and all(sum(sizes[i] for i in b) <= 2048 for b in bins)
    assert len(bins) <= 1350 < len(packing.best_fit(sorted(sizes, reverse=True), 2048))


def test_packing_searches_large_groups():
    rng = random.Random(1)
    sizes = [rng.randint(400, 899) for _ in range(18000)]
    assert len(packing.pack(sizes, 2048)) < 0.98 * len(packing.best_fit(sorted(sizes, reverse=True), 2048))
    sizes = [rng.randint(300, 1700) for _ in range(4096)]
    assert packing.least(sizes, 2048) <= len(packing.pack(sizes, 2048)) < len(packing.best_fit(sorted(sizes, reverse=True), 2048))


def test_lm(docs, empty):
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    rows = lm.score(docs, ~held).collect()
    tokens = {k: [*(t or "").encode().lower().split(), None] for k, t, *_ in documents()}
    counts = Counter(x for k, w in tokens.items() if zlib.crc32(str(k).encode()) % 7 != 2 for x in w)
    total, base = sum(counts.values()), math.log10(sum(counts.values()) + len(counts) + 1)
    for r in rows:
        w = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in counts for x in w), total)
        assert r["base_score"] == pytest.approx(sum(math.log10(counts[x] + 1) - base for x in w))
        assert math.isfinite(r["score"]) and r["score"] < 0
    assert lm.score(empty, F.lit(True)).count() == 0


def test_lm_is_normalised():
    model = lm.train(np.array([[5, 9, 1], [3, 0, 8], [2, 2, 2]]))
    assert (10 ** lm.log_probabilities(model)).sum(1) == pytest.approx(1)
    kinds, mass = np.zeros(lm.COUNTS, int), np.zeros(lm.COUNTS, int)
    kinds[1:4], mass[1:4] = [50, 20, 10], [50, 40, 35]
    each = 10 ** lm.rare_shares(kinds, mass)
    assert each[0] + (each[1:] * kinds[1:])[kinds[1:] > 0].sum() == pytest.approx(1)


def test_lm_knows_every_counted_word(spark):
    """Words beyond the most frequent are told apart by the word before them."""
    rng = random.Random(4)
    data = []
    for i in range(1000):
        own = [f"{'ab'[i % 2]}{j}" for j in range(631)]
        data.append((i, " ".join(rng.sample(rng.choices(own[:511], k=50) + rng.choices(own[511:], k=8), 58))))
    tests = {(x, j): 1000 + 200 * k + j for k, x in enumerate("ab") for j in range(120)}
    asked = [(i, f"b7 {x}{511 + j} b8") for (x, j), i in tests.items()]
    rows = lm.score(spark.createDataFrame(data + asked, "doc_id long, text string").repartition(3), F.col("doc_id") < 1000).collect()
    got = {r["doc_id"]: r["score"] for r in rows}
    middle = {x: np.median([got[tests[x, j]] for j in range(120)]) for x in "ab"}
    assert middle["b"] > middle["a"] + 0.3


def test_lm_scores_rows_with_null_and_repeated_ids(spark):
    data = [(1, "a b c"), (1, "a d"), (None, "a b"), (None, "x y z"), (2, "a b c d e")]
    rows = lm.score(spark.createDataFrame(data, "doc_id long, text string").repartition(3), F.col("doc_id") == 2).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"]) for r in rows) == [(0, 3, 3), (0, 4, 1), (1, 3, 3), (1, 4, 4), (2, 6, 6)]


def test_lm_vocabulary_is_bounded(spark, monkeypatch):
    """With fewer places in the vocabulary than frequent words, counts and base scores stay exact."""
    rng = random.Random(8)
    data = [(i, " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(300))) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    keys = ["doc_id", "n_tokens", "n_known", "train_tokens"]
    free = {r["doc_id"]: r for r in lm.score(df, F.col("doc_id") % 5 > 0).collect()}
    counted = lm.count_words(df, F.col("doc_id") % 5 > 0)
    assert lm.least_count(counted) == lm.LEAST
    monkeypatch.setattr(lm, "VOCABULARY", 12)
    counts = Counter(x for i, t in data if i % 5 for x in [*t.split(), None])
    least = lm.least_count(counted)
    assert least > lm.LEAST and sum(c >= least for c in counts.values()) <= 12 < sum(c >= max(lm.LEAST, least // 2) for c in counts.values())
    for r in lm.score(df, F.col("doc_id") % 5 > 0).collect():
        own = free[r["doc_id"]]
        assert [r[k] for k in keys] == [own[k] for k in keys] and r["base_score"] == pytest.approx(own["base_score"]) and r["score"] < 0


def test_rare_words_share_by_their_own_counts():
    counts = np.array([1, 1, 2, 3, 4, 5, 7, 8, 12, 9000, 60000, 400000])
    kinds, mass = np.bincount(lm.count_class(counts), minlength=lm.COUNTS), np.bincount(lm.count_class(counts), counts, minlength=lm.COUNTS).astype(int)
    each = 10 ** lm.rare_word(np.append(counts, 0), kinds, mass)
    assert each.sum() == pytest.approx(1)
    assert each[11] / each[10] == pytest.approx(400000 / 60000) and each[10] / each[9] == pytest.approx(60000 / 9000)


def test_lm_trains_longer_on_more_pairs():
    assert lm.steps(np.ones((3, 3))) == lm.STEPS
    assert lm.steps(np.ones((1500, 1500))) * lm.PAIRS >= 1500 * 1500


def test_language(spark, empty):
    rng = random.Random(2)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(40))
    data = [(i, make("abcde") if i % 2 else make("ñöüxy"), "aa" if i % 2 else "bb") for i in range(60)] + [(100, None, "aa"), (101, "12 !?", "bb"), (102, make("abcde"), None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language.identify(df, F.col("doc_id") < 30).collect()}
    assert all(got[k]["lang_pred"] == lang for k, _, lang in data if k < 60)
    assert [got[k]["lang_pred"] for k in (100, 101, 102)] == ["und", "und", "aa"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language.identify(df, F.lit(False)).collect()} == {"und"}
    assert language.identify(empty.withColumn("lang", F.lit("x")), F.lit(True)).count() == 0


def test_quality(spark, docs):
    rng = random.Random(4)
    data = [(i, " ".join(rng.choice(WORDS) for _ in range(40)) if i % 3 else " ".join(rng.choice(WORDS).upper() + "!!" for _ in range(40))) for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("score", F.lit("old"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.score(df, labels, F.col("doc_id") < 200).collect()}
    assert all((got[i] >= 0.3) == (i % 3 > 0) for i in range(200, 300))
    assert {r["score"] for r in quality.score(docs, labels.limit(0), F.lit(True)).collect()} == {0.5}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def fits(kind, hit):
        d = [int(c) for c in hit if c.isdigit()]
        luhn = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in hit.split(".")), "card": 16 <= len(d) <= 19 and luhn, "phone": 8 <= len(d) <= 15}[kind]

    return [(k, h.start(), h.end()) for k, p in PATTERNS.items() for h in re.finditer(p, text or "") if fits(k, h.group())]


def test_pii(spark, docs, empty):
    extra = [
        "a@b@c.d e@f.g_h@i.j..k @x.y 1.2.3.4.5.6.7.8 0255.00.0.1 🙂a@b.co 4111-1111-1111-1111 +12 (3)4-5.6789 +1234567",
        "x" * 20000 + "@" + "y." * 3000 + "z", "9" * 5000, "call me on (212) 555-0100 or jo [at] ex [dot] com", None, "",
    ]
    df = docs.select("doc_id", "text").unionAll(spark.createDataFrame(list(enumerate(extra, 1000)), "doc_id long, text string"))
    found = pii.find(df)
    for r in found.collect():
        assert [(x["kind"], x["s"], x["e"]) for x in r["pii"] if x["base"]] == base_spans(r["text"])
    masked = {r["doc_id"]: r["text"] for r in pii.mask(found).collect()}
    assert masked[1000].count("[EMAIL]") == 4 and "4111" not in masked[1000]
    assert masked[10] == "" or masked[10] is None
    assert pii.find(empty).count() == 0


def vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 64))
    near = [base[i % 20] + rng.standard_normal(64) * s for i, s in enumerate(np.linspace(0.05, 0.6, 60))]
    rows = [(i, [float(np.float32(x)) for x in v], i % 20 % 3) for i, v in enumerate([*base, *near])]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, rows[0][1], None), (203, None, 1), (204, [0.0] * 64, 1), (205, [float("nan")] * 64, 1), (206, [None, 1.0], 1), (220, rows[5][1], 2)]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, extra string")


def test_top_k(spark):
    rows, df = vectors(spark)
    fit = {i: np.floor(64 * np.array(v, float)) for i, v, _ in rows if v is not None and not any(x is None or not math.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in fit if i % 20 == 0):
        ranked = sorted((-int(fit[q] @ fit[i]), i) for i in fit if i != q)[:20]
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(ranked, 1)}
    assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 20).collect()} == want
    assert topk.top_k(df.limit(0), F.lit(True), 20).count() == 0
    big = topk.search(np.array([1, 2]), np.array([[2.0**60], [-(2.0**60)]]), np.array([1]), np.array([[2.0]]), 1)
    assert big == [(1, 2, -(2**61))]


def test_caps(spark):
    rows, df = vectors(spark)
    fit = {i: (np.array(v, float), lab) for i, v, lab in rows if v is not None and lab is not None and not any(x is None or not math.isfinite(x) for x in v) and any(v)}
    links = {i: {j for j in fit if j != i and fit[i][1] == fit[j][1] and fit[i][0] @ fit[j][0] / np.linalg.norm(fit[i][0]) / np.linalg.norm(fit[j][0]) >= 0.93} for i in fit}
    got = {r["vec_id"]: r for r in caps.near_vectors(df, 0.93).collect()}
    assert len(got) == len(rows) and all(got[i]["n_links"] == 0 and got[i]["kept"] for i, _, _ in rows if i not in fit)
    total, found = sum(map(len, links.values())), sum(got[i]["n_links"] for i in fit)
    assert 0.9 * total <= found <= total
    assert all(got[i]["component_id"] == 0 for i in (200, 201))
    assert caps.near_vectors(df.limit(0), 0.93).count() == 0


def test_language_knows_every_language(spark):
    langs = [(k, chr(0x4E00 + 3 * k) * 9 + " " + chr(0x4E01 + 3 * k) * 9) for k in range(205)]
    data = [(10 * k + i, text, f"l{k:03}") for k, text in langs for i in range(1 + (k < 204))] + [(9000 + k, text, None) for k, text in langs]
    rows = language.identify(spark.createDataFrame(data, "doc_id long, text string, lang string"), F.lit(True)).where("doc_id >= 9000").collect()
    assert {r["doc_id"]: r["lang_pred"] for r in rows} == {9000 + k: f"l{k:03}" for k, _ in langs}

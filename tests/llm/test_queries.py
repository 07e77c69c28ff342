"""The registered queries themselves, on whole small tables: their columns, hold-outs and values."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from larkspur.llm import bpe
from larkspur.llm.queries import QUERIES

from .test_operators import base_spans, shingles
from .test_rows import jaccard_rows
from .test_substring import expected

LETTERS = {"aa": "abcdefgh", "bb": "mnopqrst", "cc": "äöüßéxyz"}


def rows():
    """(doc_id, text, lang, source, quality): clean prose in three languages, shouted junk, copies, near
    copies, shared passages, personal data, empty and null texts, null labels and a text of 30,000 words."""
    rng = random.Random(21)
    word = lambda lang: "".join(rng.choice(LETTERS[lang]) for _ in range(rng.randrange(2, 9)))
    vocabulary = {lang: [word(lang) for _ in range(400)] for lang in LETTERS}
    passage = " ".join(rng.choices(vocabulary["aa"], k=60))
    out = []
    for i in range(240):
        lang = "abc"[i % 3] * 2
        words = rng.choices(vocabulary[lang], k=rng.randrange(30, 120))
        junk = i % 8 == 5
        if junk:
            words = [w.upper() + "!!!" for w in words[:25]]
        if i % 20 == 3:
            words[10:10] = [passage]
        if i % 24 == 1:
            words += [f"user{i}@mail.example.com", "10.1.2.3", "4111 1111 1111 1111", "+1 (212) 555-0100"]
        out.append([i, " ".join(words), lang, "web", int(not junk)])
    for i in range(12):
        copy = out[3 * i][1].split()
        if i % 2:
            copy[5] = "edited"
        out.append([300 + i, " ".join(copy), out[3 * i][2], "web", out[3 * i][4]])
    out += [[400, None, "aa", None, None], [401, "", None, "x", 0], [402, " \n", "bb", "x", 0], [403, "12 !? 34", "aa", "x", None], [404, " ".join(rng.choices(vocabulary["bb"], k=30000)), None, "x", 1]]
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = [(k, t, lang, s, len(t or ""), "extra") for k, t, lang, s, _ in rows()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, q, 0) for k, *_, q in rows() if q is not None], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    rng = np.random.default_rng(8)
    base = rng.standard_normal((40, 64))
    vectors = [(i, (base[i % 40] + rng.standard_normal(64) * 0.2 * (i % 3)).astype(np.float32).tolist(), i % 4) for i in range(160)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder, vectors


def run(spark, tables, name):
    df = QUERIES[name](spark, tables[0])
    out = df.collect()
    assert out == [] or "doc_id" not in df.columns or name == "op10_packing" or sorted(r["doc_id"] for r in out) == sorted(k for k, *_ in rows())
    return out, dict(df.dtypes)


def crc(k, n):
    return zlib.crc32(str(k).encode()) % n


def test_op1(spark, tables):
    out, kinds = run(spark, tables, "op1_jaccard")
    assert kinds == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"}
    assert sorted(map(tuple, out)) == sorted(jaccard_rows([(k, t) for k, t, *_ in rows()])[0])
    assert len(shingles(rows()[-1][1])) > 29000


def test_op2(spark, tables):
    out, kinds = run(spark, tables, "op2_lm")
    assert kinds == {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"}
    tokens = {k: [*(t or "").lower().encode().split(), None] for k, t, *_ in rows()}
    counts = Counter(x for k, w in tokens.items() if crc(k, 7) != 2 for x in w)
    for r in out:
        w = tokens[r["doc_id"]]
        if not any(x and any(b > 127 for b in x) for x in w):  # lower() here knows more letters than A-Z
            assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (crc(r["doc_id"], 7) == 2, len(w), sum(counts.values()))
    held = [r for r in out if r["held_out"] and r["n_tokens"] > 20]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_op3(spark, tables):
    out, kinds = run(spark, tables, "op3_language")
    assert kinds == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    lang = {k: x for k, _, x, *_ in rows()}
    assert all(r["held_out"] == (crc(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in out)
    by = {r["doc_id"]: r["lang_pred"] for r in out}
    assert {by[k] for k in (400, 401, 402, 403)} == {"und"} and by[404] == "bb"
    held = [r for r in out if r["held_out"] and r["doc_id"] < 400]
    assert len(held) > 40 and all(r["lang_pred"] == lang[r["doc_id"]] for r in held)


def test_op4(spark, tables):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(bpe.tokenizer_path())
    out, _ = run(spark, tables, "op4_bpe")
    text = {k: t for k, t, *_ in rows()}
    for r in out:
        ids = own.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids
        decoded = own.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_op5(spark, tables):
    out, kinds = run(spark, tables, "op5_substring")
    assert kinds == {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"}
    want = {(k, n, m, hashlib.sha256(t.encode()).hexdigest()) for k, n, m, t in expected([(k, t) for k, t, *_ in rows()])}
    assert {tuple(r) for r in out} == want and sum(m for _, _, m, _ in want) > 500


def test_op6(spark, tables):
    out, kinds = run(spark, tables, "op6_quality")
    assert kinds == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    good = {k: q for k, *_, q in rows()}
    assert all(r["held_out"] == (crc(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] < 400]
    assert len(held) > 40 and sum(r["predicted"] == good[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_op7(spark, tables):
    out, _ = run(spark, tables, "op7_pii")
    text = {k: t for k, t, *_ in rows()}
    for r in out:
        base = base_spans(text[r["doc_id"]])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[0] == k for x in base) for k in ("email", "ip", "card", "phone")]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def test_op8(spark, tables):
    out, kinds = run(spark, tables, "op8_topk")
    assert kinds == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    x = np.floor(64 * np.array([v for _, v, _ in tables[1]], np.float64))
    want = {(q, n, i, -s) for q in range(0, 160, 20) for n, (s, i) in enumerate(sorted((-int(x[q] @ x[i]), i) for i in range(160) if i != q)[:20], 1)}
    assert {tuple(r) for r in out} == want


def test_op9(spark, tables):
    out, kinds = run(spark, tables, "op9_caps")
    assert kinds == {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}
    x, label = np.array([v for _, v, _ in tables[1]], np.float64), np.array([lab for *_, lab in tables[1]])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.93) & (label[:, None] == label)
    assert 0.9 * (links.sum() - 160) <= sum(r["n_links"] for r in out) <= links.sum() - 160
    assert len(out) == 160 and all(r["kept"] == (r["vec_id"] == r["component_id"]) and r["component_id"] <= r["vec_id"] for r in out)
    assert all(r["kept"] for r in out if not r["n_links"])


def check_packing(out, kept):
    """Pieces of each kept text fill its ids, and sequences are gapless and at most 2048 long."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(bpe.tokenizer_path())
    pieces, bins = {}, {}
    for r in out:
        pieces.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(kept)
    for k, text in kept.items():
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 0]
        mine = sorted(pieces[k], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine))) and all(r["length"] == 2048 for r in mine[1:]) and sum(r["length"] for r in mine) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in mine)
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    return bins


def test_op10(spark, tables):
    out, _ = run(spark, tables, "op10_packing")
    bins = check_packing(out, {k: t for k, t, *_ in rows()})
    assert len(bins) <= -(-sum(r["length"] for r in out) // 2048) + 1


def test_pipeline_against_brute_force(spark, tables):
    """Each stage's rows, texts included, from the rows of the one before by brute force; what the two
    learned stages decide is taken from their operators' own results."""
    folder, docs = tables[0], spark.read.parquet(f"{tables[0]}/documents.parquet")
    held = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, folder).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        held[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == list(corpus_pipeline.COLUMNS) and docs.count() == len(held[name])
    text = {k: t for k, t, *_ in rows()}
    good = {r["doc_id"] for r in run(spark, tables, "op6_quality")[0] if r["score"] >= corpus_pipeline.LEAST_QUALITY}
    assert held["quality"] == {k: text[k] for k in good}
    groups = jaccard_rows(list(held["quality"].items()))[0]
    assert held["near_copies"] == {k: text[k] for k, _, low in groups if k == low}
    cut = {k: (kept if removed else text[k]) for k, _, removed, kept in expected(list(held["near_copies"].items()))}
    assert held["repeats"] == cut
    for k, t in held["private"].items():
        found = base_spans(cut[k])
        assert (t == cut[k]) if not found else all((cut[k] or "")[s:e] not in t for _, s, e in found)
    check_packing(corpus_pipeline.run(spark, folder).collect(), held["private"])

"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model learns from a bounded sample, at most PER_LANGUAGE documents of each language (chosen
by a hash of doc_id); its log-probability matrix is broadcast (its size is fixed by the number of
languages and of buckets). Whole texts are scored in numpy, batch by batch, without a shuffle.

Cases: a null text and one without a letter give `und` with score 0; equal likelihoods go to the
language that is first in order; without any row to learn from, every row is `und`; rows that repeat,
and rows with null or repeated ids, are predicted each for itself (those without an id teach nothing);
a very long text is scored whole by one task; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, pieces

#: Buckets of the hash, sizes of the n-grams, documents learnt from for each language.
BUCKETS, SIZES, PER_LANGUAGE = 1 << 15, (1, 2, 3), 1500


def grams(column: pa.Array):
    """Buckets of the n-grams of each size: for each size an array and the first place of each row.
    A text is lower-cased in Latin letters and stands between two spaces."""
    texts = pc.fill_null(column, "").cast(pa.string())
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    body = "".join(f" {t} " for t in texts.to_pylist())
    codes = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), np.uint32)
    upper = (codes >= 65) & (codes <= 90) | (codes >= 0xC0) & (codes <= 0xDE) & (codes != 0xD7)
    codes = (codes + 32 * upper).astype(np.uint64)
    first = size.cumsum() - size
    for n in SIZES:
        h = np.zeros(max(0, len(codes) - n + 1), np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + codes[j : j + len(h)] + np.uint64(n)
        yield (mix(h) >> np.uint64(64 - 15)).astype(np.int32), first, first + np.maximum(size - n + 1, 0)


def has_letter(texts: list[str | None]) -> np.ndarray:
    return np.array([t is not None and any(c.isalpha() for c in t[:64]) or (t is not None and any(c.isalpha() for c in t[64:])) for t in texts], bool)


def learn(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log-probabilities (buckets x languages) with log-priors in a last row."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return [], np.zeros((BUCKETS + 1, 0), np.float32)
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, PER_LANGUAGE / r["count"]) * 1_000_003))])
    sample = rows.where(F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1_000_003)) < F.element_at(share, F.col("lang"))).select("lang", "text")

    def count(batches):
        found: dict[str, np.ndarray] = {}
        for batch in pieces(batches):
            langs = np.array(batch.column("lang").to_pylist(), object)
            for h, first, end in grams(batch.column("text")):
                for i, (a, b) in enumerate(zip(first.tolist(), end.tolist(), strict=True)):
                    own = found.setdefault(langs[i], np.zeros(BUCKETS, np.int64))
                    own += np.bincount(h[a:b], minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([c.tobytes() for c in found.values()], pa.binary())], names=["lang", "counts"])

    total: dict[str, np.ndarray] = {}
    for r in sample.repartition(6).mapInArrow(count, "lang string, counts binary").toLocalIterator():
        total[r["lang"]] = total.get(r["lang"], 0) + np.frombuffer(r["counts"], np.int64)
    names = sorted(total)
    table = np.stack([total[k] for k in names], 1) + 0.5
    prior = np.array([dict((r["lang"], r["count"]) for r in counts)[k] for k in names], float)
    return names, np.vstack([np.log(table / table.sum(0)), np.log(prior / prior.sum())]).astype(np.float32)


def identify(docs: DataFrame, learning: Column) -> DataFrame:
    """doc_id, lang_pred and score for each row of docs (doc_id, text, lang); rows for which
    `learning` holds, and no others, may teach the model."""
    names, table = learn(docs.where(learning))
    model = docs.sparkSession.sparkContext.broadcast(table)

    def rows(batches):
        matrix, prior = model.value[:-1], model.value[-1].astype(float)
        for batch in pieces(batches, most=1 << 20):
            texts = batch.column("text").to_pylist()
            total = np.tile(prior, (len(texts), 1))
            for h, first, end in grams(batch.column("text")):
                for k in range(len(names)):
                    s = np.concatenate([[0.0], np.cumsum(matrix[:, k][h], dtype=np.float64)])
                    total[:, k] += s[np.minimum(end, len(h))] - s[np.minimum(first, len(h))]
            known = has_letter(texts) if names else np.zeros(len(texts), bool)
            best = total.argmax(1) if names else np.zeros(len(texts), int)
            score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1) if names else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([names[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)], pa.string()), pa.array(np.where(known, np.clip(score, 0, 1), 0.0))], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, lang_pred string, score double")


def op3_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return identify(docs, ~held_out).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score")

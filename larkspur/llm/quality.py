"""Quality classifier: histogram gradient-boosted trees over statistics of a document's text.

Trees are grown level by level on binned statistics of a bounded sample of labelled rows (at most
SAMPLE, chosen by a hash of doc_id), then flattened into arrays that numpy walks for a whole batch
at once. Scores are made where the rows lie, without a shuffle.

Cases: a null text counts as empty and is scored like any other; of several labels of one document
the highest counts; without labels, or with labels of one kind, every row has that share of ones
as its score (0.5 without labels); rows that repeat, and rows with null or repeated ids, are scored each
for itself; a very long text is scored whole by one task; an empty table gives no rows; other columns
stay, but for one that is called score, which is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import STEP, mix, pieces, text_arrays, words

#: Labelled rows to learn from at most; trees, their depth, bins of a statistic, learning rate.
SAMPLE, TREES, DEPTH, BINS, RATE = 20_000, 80, 4, 64, 0.15
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b".", b",", b"!?", b"|", b"#$%&*@^~", b"<>{}[]()/\\=_", b":;'\"-+"]


def per_row(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]


def repeated(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each row, the share of its keys that repeat an earlier one of the row."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    own = mix(keys ^ mix(row.astype(np.uint64)))
    _, first = np.unique(own, return_index=True)
    new = np.zeros(len(keys))
    new[first] = 1
    return 1 - per_row(new, at) / np.maximum(np.diff(at), 1)


def statistics(column: pa.Array) -> np.ndarray:
    """A row of numbers for each text, computed from the whole text."""
    data, offsets = text_arrays(column)
    start, end, h, at = words(data, offsets, True)
    size, count, length = np.diff(offsets), np.diff(at), (end - start).astype(float)
    full, many = np.maximum(size, 1), np.maximum(count, 1)
    out = [np.log1p(size), np.log1p(count), per_row(length, at) / many]
    for chars in CLASSES:
        is_in = np.zeros(256, bool)
        is_in[list(chars)] = True
        out.append(per_row(is_in[data], offsets) / full)
    out.append(per_row(data >= 128, offsets) / full)
    mean = out[2]
    out.append(np.sqrt(np.maximum(per_row(length**2, at) / many - mean**2, 0)))
    out += [per_row(length <= 2, at) / many, per_row(length >= 12, at) / many, repeated(h, at)]
    last = data[end - 1] if len(end) else data[:0]
    letter = np.zeros(256, bool)
    letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
    upper = np.zeros(256, bool)
    upper[65:91] = True
    out += [per_row(~letter[last], at) / many, per_row(upper[data[start]] & upper[last] if len(end) else last, at) / many]
    # runs of three words and whole lines that come again
    three = np.zeros(len(h), np.uint64)
    for j in range(3):
        three[: max(0, len(h) - j)] += h[j:] * STEP[j]
    out.append(repeated(three, at))
    out.append(per_row(data == 10, offsets) / many)
    return np.stack(out, 1)


def grow(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Trees as arrays: at node n of a tree, go to 2n+1 if the statistic is at most the cut, else to 2n+2."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    score, inner = np.full(len(y), base), 2**DEPTH - 1
    feature, cut, value = np.zeros((TREES, inner), np.int32), np.full((TREES, inner), np.inf), np.zeros((TREES, inner + 1))
    for t in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, w = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, n = 2**level - 1, 2**level
            best = np.full(n, 1e-6)
            chosen, place = np.zeros(n, int), np.full(n, BINS)
            for f in range(x.shape[1]):
                key = (node - first) * BINS + binned[:, f]
                sg = np.bincount(key, g, n * BINS).reshape(n, BINS).cumsum(1)
                sw = np.bincount(key, w, n * BINS).reshape(n, BINS).cumsum(1)
                gain = sg**2 / (sw + 1) + (sg[:, -1:] - sg) ** 2 / (sw[:, -1:] - sw + 1) - sg[:, -1:] ** 2 / (sw[:, -1:] + 1)
                gain[(sw < 1) | (sw[:, -1:] - sw < 1)] = 0
                at = gain.argmax(1)
                top = gain[np.arange(n), at]
                better = top > best
                best[better], chosen[better], place[better] = top[better], f, at[better]
            feature[t, first : first + n] = chosen
            cut[t, first : first + n] = [edges[f][b] if b < len(edges[f]) else np.inf for f, b in zip(chosen, place, strict=True)]
            node = 2 * node + 1 + (x[np.arange(len(y)), chosen[node - first]] > cut[t, node])
        leaf = node - inner
        value[t] = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, w, inner + 1) + 1)
        score += value[t][leaf]
    return {"base": np.array(base), "feature": feature, "cut": cut, "value": value}


def walk(trees: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each row of statistics."""
    total, every = np.full(len(x), float(trees["base"])), np.arange(len(x))
    for feature, cut, value in zip(trees["feature"], trees["cut"], trees["value"], strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[every, feature[node]] > cut[node])
        total += value[node - len(feature)]
    return 1 / (1 + np.exp(-total))


def learn(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    labels = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    total = labels.count()
    if total > SAMPLE:
        labels = labels.where(F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1_000_003)) < F.lit(int(1_000_003 * 0.97 * SAMPLE / total)))
    labels = labels.limit(SAMPLE)  # a bound for the broadcast; the hash already keeps to it
    joined = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id")
    width = statistics(pa.array([""])).shape[1]

    def rows(batches):
        for batch in pieces(batches):
            x = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("quality").cast(pa.float64()), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), width).cast(pa.list_(pa.float64())), batch.column("doc_id")], names=["y", "x", "doc_id"])

    found = joined.mapInArrow(rows, "y double, x array<double>, doc_id long").toPandas().sort_values("doc_id", kind="stable")
    y = found["y"].to_numpy(float) > 0
    if not len(y) or y.all() or not y.any():
        share = np.clip(y.mean() if len(y) else 0.5, 1e-9, 1 - 1e-9)
        return {"base": np.array(np.log(share / (1 - share))), "feature": np.zeros((0, 1), np.int32), "cut": np.zeros((0, 1)), "value": np.zeros((0, 2))}
    return grow(np.stack(found["x"].to_list()), y.astype(float))


def score(docs: DataFrame, labels: DataFrame, learning: Column) -> DataFrame:
    """Every row of docs with a column score; labels (doc_id, quality) teach where `learning` holds.
    Other columns of docs stay; one that is called score is replaced."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels.select("doc_id", "quality").where(learning)))
    docs = docs.drop("score")
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "score double"])

    def rows(batches):
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(walk(model.value, statistics(batch.column("text"))))], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(rows, fields)


HELD_OUT = "crc32(cast(doc_id as string)) % 5 = 0"


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~F.expr(HELD_OUT)).select("doc_id", "score")
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

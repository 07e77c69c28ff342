"""Pieces that the training-data operators share: hashing of words in numpy, routed
arrays, tables in the shared checkpoint folder and connected components.

Hashes are 64-bit and come from fixed constants, so that any executor gives the same
value for the same bytes; a lost task can be run again anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import again, dropped, numbered, stored

__all__ = ["again", "dropped", "numbered", "stored"]
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64 bits (xor-shift and multiply), element by element."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE = mix((np.arange(256, dtype=np.uint64) + U64(1)) * _BASE)
BYTE_LOWER = BYTE.copy()
BYTE_LOWER[65:91] = BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
STEP = mix((np.arange(64, dtype=np.uint64) + U64(1000)) * _BASE) | U64(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse, grown on demand and kept by the worker."""

    up = _powers(_BASE, 1)
    down = _powers(_BASE_INV, 1)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_BASE, n + n // 4), _powers(_BASE_INV, n + n // 4)
        return cls.up, cls.down


def range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each values[start:end], the same wherever the same values stand."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _Powers.of(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + mix((end - start).astype(np.uint64)))


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the offsets of the rows in them; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about `most` bytes of text each, to bound the memory of numpy."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at, total = 0, np.concatenate([[0], np.cumsum(size)])
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+`: start and end of each in data, its hash, and the first word of each row."""
    inside = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    start, end = inside.copy(), inside.copy()
    if len(data):
        start[1:] &= ~inside[:-1] | first[1:-1]
        end[:-1] &= ~inside[1:] | first[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return start, end, word_hashes(data, start, end, BYTE_LOWER if lower else BYTE), np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, byte: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """range_hash of data's bytes in blocks of `most`, so that a very long text takes no more tables;
    words that lie in two blocks or more are summed block by block."""
    out = np.zeros(len(start), np.uint64)
    for at in range(0, max(len(data), 1), most):
        i, j = np.searchsorted(start, [at, at + most])
        whole = j - int(i < j and end[j - 1] > at + most)
        out[i:whole] = range_hash(byte[data[at : at + most]], start[i:whole] - at, end[i:whole] - at)
        if whole < j:
            a, b, total = int(start[whole]), int(end[whole]), np.zeros(1, np.uint64)
            for p in range(a, b, most):
                part = byte[data[p : min(p + most, b)]]
                total += (part * _Powers.of(len(part) + 1)[0][: len(part)]).sum(keepdims=True) * U64(pow(int(_BASE), p - a, 1 << 64))
            out[whole] = mix(total + mix(np.full(1, b - a, np.uint64)))[0]
    return out


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each row's words, lower-cased in A-Z; a
    shorter text with words gives its whole sequence as one."""
    data, offsets = text_arrays(column)
    _, _, h, at = words(data, offsets, True)
    count = max(0, len(h) - n + 1)
    rolled = np.zeros(count, np.uint64)
    for j in range(n):
        rolled += h[j : j + count] * STEP[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            out.append(mix((h[a:b] * STEP[: b - a]).sum(keepdims=True) + U64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def flat(arrays: list[np.ndarray]) -> pa.Array:
    """One binary value for each array."""
    lengths = np.array([0, *(a.nbytes for a in arrays)], np.int64).cumsum()
    body = np.concatenate(arrays).tobytes() if arrays else b""
    return pa.Array.from_buffers(pa.large_binary(), len(arrays), [None, pa.py_buffer(lengths), pa.py_buffer(body)]).cast(pa.binary())


def routed(key: np.ndarray, columns: list[np.ndarray], buckets: int, names: list[str]) -> pa.RecordBatch:
    """Columns dealt out by key: a row for each bucket, each column's values as one binary."""
    bucket = ((key >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    out = [pa.array(found.astype(np.int32))]
    for c in columns:
        c = c[order]
        out.append(flat([c[a:b] for a, b in zip(first.tolist(), [*first[1:].tolist(), len(c)], strict=True)]))
    return pa.RecordBatch.from_arrays(out, names=["bucket", *names])


def gathered(batches: Iterator[pa.RecordBatch], types: dict[str, type]) -> dict[str, np.ndarray]:
    """The routed columns of a whole partition, one array each."""
    parts: dict[str, list[np.ndarray]] = {k: [] for k in types}
    for batch in batches:
        for k, kind in types.items():
            column = batch.column(k).cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            parts[k].append(np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy().view(kind) if offsets[-1] > offsets[0] else np.zeros(0, kind))
    return {k: np.concatenate(v) if v else np.zeros(0, types[k]) for k, v in parts.items()}


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets(spark: SparkSession, rows: int, per_bucket: int = 250_000) -> tuple[int, int]:
    """Buckets and partitions for so many routed values: more of both as the data grow."""
    n = max(partitions(spark), -(-rows // (4 * per_bucket)))
    return max(128, 4 * n), n


#: Bytes of text of a file of numbered rows.
BYTES = 1 << 24


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def numbered_texts(docs: DataFrame, name: str) -> tuple[DataFrame, int]:
    """numbered() for documents, in files of about BYTES of text however many partitions docs has, and
    the bytes of all texts."""
    size = text_bytes(docs)
    return numbered(docs.coalesce(max(1, -(-size // BYTES))), name), size


def hot_keys(docs: DataFrame, keys: Callable[[pa.RecordBatch], list[np.ndarray]], sample: int = 20_000, least: int = 8, most: int = 1 << 18) -> np.ndarray:
    """Keys that many documents hold, sorted: those in `least` or more of about `sample` documents,
    at most `most` of them. They only decide an order of work; results don't depend on them."""
    spark = docs.sparkSession
    total = docs.select("doc_id").count()
    part = docs.select("doc_id", "text")
    if total > sample:
        part = part.where(F.pmod(F.xxhash64(F.lit("hot"), "doc_id"), F.lit(1_000_003)) < F.lit(int(1_000_003 * sample / total)))
    n = max(128, 4 * partitions(spark))

    def emit(batches):
        for b in pieces(batches):
            k = np.concatenate([np.zeros(0, np.uint64), *keys(b)])
            if len(k):
                yield routed(k, [k], n, ["k"])

    def count(batches):
        k, c = np.unique(gathered(batches, {"k": np.uint64})["k"], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(signed(k[c >= least])), pa.array(c[c >= least])], names=["k", "c"])

    found = part.mapInArrow(emit, "bucket int, k binary").repartition(partitions(spark), "bucket").select("k").mapInArrow(count, "k long, c long")
    rows = found.orderBy(F.desc("c"), "k").limit(most).select("k").toArrow()
    return np.sort(rows.column("k").to_numpy().view(np.uint64))


def is_in(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return sorted_keys[at] == x


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of undirected edges (a, b), a stored table: the smallest node reachable.
    Alternating large and small stars; a step's minima are aggregated before the shuffle, and a
    star's many edges meet its minimum in a join that Spark can split. No row: no edges."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), edges.count())
    mark = None
    while True:  # a step has as many edges as the one before at most
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or seen == mark:
            break
        mark = seen
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        after = stored(small, seen[0])
        dropped(now)
        now = after
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

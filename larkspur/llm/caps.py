"""Near-duplicate vectors by spherical-cap filters from structured random product codes.

A filter direction joins one codeword of each of BLOCKS blocks of dimensions. A vector is
list-decoded to all directions that it exceeds by a bound, and to its best ones at least: of the sums
of the first two blocks and of the last two only those that can reach the bound with the other side's
best are sorted, and only pairs that reach it are listed. Codewords and bound follow the number of
vectors of the largest label, so that a direction has as many vectors of a label in a large table as
in a small one, and a vector a few more directions. Vectors that share a label and a direction are
compared by their exact cosine; a pair is counted where its first common direction is. Equal vectors
are one class with a count, and large groups are cut into cells of CELL by CELL vectors, so that a
third of all rows in one group is spread over many tasks.

Cases: vectors that are null or zero, or hold null or non-finite components, and rows without a
label link with nothing; so do rows without a vec_id, whose component_id is null. Rows that repeat a
vec_id are rows of their own: equal ones link, others as their vectors do. A shorter vector counts as
filled up with zeros; labels and components may have any type that can be compared; other columns
play no part; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, numbered, partitions, stored
from .topk import usable

#: Blocks; for PER vectors of a label or fewer: codewords of a block, and how many directions a vector
#: has on average by the bound, and at least (its best ones).
BLOCKS, WORDS, PER, ABOVE, LEAST = 4, 24, 20_000, 10.5, 14
#: Codewords of a block at most: numbers of directions have 32 bits.
MOST = 255
CELL, ROWS = 512, 40_000


@dataclass(frozen=True)
class Size:
    """Codewords of a block, the bound in standard deviations of a random direction, directions at least."""

    words: int
    bound: float
    least: int


def size_for(vectors: int) -> Size:
    """As many directions for each vector of a label as there are for PER; a vector's own grow with the
    power of them that near vectors need to meet as often (0.036 for a cosine of 0.93; 0.05 here)."""
    words = min(MOST, max(WORDS, int(np.ceil(WORDS * (vectors / PER) ** (1 / BLOCKS)))))
    more = (words / WORDS) ** (BLOCKS * 0.05)
    return Size(words, NormalDist().inv_cdf(1 - ABOVE * more / words**BLOCKS), int(np.ceil(LEAST * more)))


@cache
def codebook(width: int, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """n unit codewords of each block, the same on every machine, and the blocks' borders."""
    rng = np.random.Generator(np.random.PCG64(20240601 + width))
    cuts = np.linspace(0, width, BLOCKS + 1).astype(int)
    books = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        book = rng.standard_normal((n, b - a))
        books.append(book / np.maximum(np.linalg.norm(book, axis=1, keepdims=True), 1e-12))
    return books, cuts


def decode(x: np.ndarray, size: Size) -> list[np.ndarray]:
    """Sorted directions of each unit vector."""
    books, cuts = codebook(x.shape[1], size.words)
    s = [x[:, a:b] @ book.T for book, a, b in zip(books, cuts[:-1], cuts[1:], strict=True)]
    bound = size.bound * np.sqrt(BLOCKS / x.shape[1])
    left = (s[0][:, :, None] + s[1][:, None, :]).reshape(len(x), -1)
    right = (s[2][:, :, None] + s[3][:, None, :]).reshape(len(x), -1)
    k = min(size.least, left.shape[1])
    best = [-np.sort(-np.partition(v, v.shape[1] - k, axis=1)[:, -k:], 1) for v in (left, right)]
    out = []
    for i in range(len(x)):
        limit = min(bound, np.partition((best[0][i][:, None] + best[1][i]).ravel(), -k)[-k])
        at = [np.flatnonzero(v[i] >= limit - other[i, 0] - 1e-12) for v, other in ((left, best[1]), (right, best[0]))]
        at = [p[np.argsort(-v[i, p], kind="stable")] for v, p in zip((left, right), at, strict=True)]
        a, b = left[i, at[0]], right[i, at[1]]
        many = np.searchsorted(-b, -(limit - a), "right")
        rows = np.repeat(np.arange(len(many)), many)
        cols = np.arange(len(rows)) - np.repeat(many.cumsum() - many, many)
        out.append(np.sort(at[0][rows] * size.words**2 + at[1][cols]))
    return out


def matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def pairs_of(first: np.ndarray, size: np.ndarray, x: np.ndarray, side: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows a < b of one group with a cosine of at least `least`; groups are runs of rows. Groups of
    one size are compared together. side: 0 and 1 for a cell's two parts, 2 where both are the same."""
    norm = np.linalg.norm(x, axis=1)
    unit = x / norm[:, None]
    out = []
    for k in np.unique(size[size > 1]).tolist():
        starts, step = first[size == k], max(1, 4_000_000 // (k * max(k, x.shape[1])))
        for at in range(0, len(starts), step):
            rows = starts[at : at + step, None] + np.arange(k)
            v = unit[rows]
            g, i, j = np.nonzero(v @ v.transpose(0, 2, 1) >= least - 1e-9)
            keep = i < j
            a, b = rows[g[keep], i[keep]], rows[g[keep], j[keep]]
            keep = (side[a] != side[b]) | (side[a] == 2)
            out.append((a[keep], b[keep]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate([o[i] for o in out]) for i in (0, 1))
    exact = np.empty(len(a), bool)
    for at in range(0, len(a), 50_000):
        p, q = a[at : at + 50_000], b[at : at + 50_000]
        exact[at : at + 50_000] = np.einsum("ij,ij->i", x[p], x[q]) / (norm[p] * norm[q]) >= least
    return a[exact], b[exact]


def first_common(a: np.ndarray, b: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """Smallest direction that the rows of each pair share, by sorting both rows' lists together."""
    flat, size = np.concatenate(lists).astype(np.int64), np.array(list(map(len, lists)))
    start, out = size.cumsum() - size, np.full(len(a), -1, np.int64)
    total = np.cumsum(size[a] + size[b])
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 4_000_000, "right")))
        keys = []
        for rows in (a[at:to], b[at:to]):
            n = size[rows]
            places = np.repeat(start[rows] - (n.cumsum() - n), n) + np.arange(n.sum())
            keys.append(np.repeat(np.arange(len(rows)), n) << 32 | flat[places])
        keys = np.sort(np.concatenate(keys))
        twice = keys[1:][keys[1:] == keys[:-1]]
        pair, first = np.unique(twice >> 32, return_index=True)
        out[at + pair] = twice[first] & 0xFFFFFFFF
        at = to
    return out


def linked(group: np.ndarray, direction: np.ndarray, ids: np.ndarray, copies: np.ndarray, x: np.ndarray, lists: list[np.ndarray], side: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of many cells, whose rows are sorted by group: for each row with any, its id, the copies
    that it links to, and the smallest id of its linked rows in the cell."""
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(first, len(group)))
    a, b = pairs_of(first, size, x, side, least)
    fresh = first_common(a, b, lists) == direction[a] if len(a) else np.zeros(0, bool)
    a, b = a[fresh], b[fresh]  # a pair counts in the first direction that both rows have
    links, root = np.zeros(len(ids), np.int64), ids.astype(np.int64).copy()
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    while len(a):
        low = np.minimum(root[a], root[b])
        if (low == root[a]).all() and (low == root[b]).all():
            break
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
    has = links > 0
    return ids[has], links[has], root[has]


def near_vectors(vectors: DataFrame, least: float, size: Size | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label). size: of
    the codebook; by the rows if it isn't given."""
    rows = vectors.select("vec_id", "embedding", "label")
    fit = rows.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0))
    classes = numbered(fit.groupBy("label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("low")), "rep")
    width = classes.agg(F.max(F.size("embedding"))).first()[0] or 1
    size = size or size_for(classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0)
    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}

    def directions(batches):
        step = max(1, min(512, (1 << 22) // size.words**2))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = matrix(part.column("embedding").to_pylist(), width)
                x /= np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
                found = decode(x / np.linalg.norm(x, axis=1, keepdims=True), size)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.int64()))], names=[*part.schema.names, "directions"])

    decoded = stored(classes.select("label", "embedding", "copies", "rep").mapInArrow(directions, f"label {kinds['label']}, embedding {kinds['embedding']}, copies long, rep long, directions array<long>"))
    each = decoded.select("label", "rep", F.explode("directions").alias("direction"))
    sizes = each.groupBy("label", "direction").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / CELL).cast("int")
    cells = (
        each.join(sizes, ["label", "direction"])
        .withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumn("side", F.when(F.col("part") == F.col("other"), 2).otherwise((F.col("part") > F.col("other")).cast("int")))
        .withColumn("i", F.least("part", "other"))
        .withColumn("j", F.greatest("part", "other"))
        .select("rep", "direction", "side", "i", "j")
        .join(decoded, "rep")  # vectors only for rows that share a direction
    )

    names = ["label", "direction", "i", "j"]
    total = decoded.agg(F.sum(F.size("directions"))).first()[0] or 0
    parts_n = max(partitions(vectors.sparkSession), -(-total // ROWS))

    def compare(batches):
        held, rows, last = [], 0, None
        for batch in batches:
            key = list(zip(*(batch.column(n).to_pylist() for n in names), strict=True))
            at = 0
            while at < len(key):  # cut where a group begins and enough rows are there
                to = len(key)
                if rows >= ROWS:
                    to = next((k for k in range(at, len(key)) if key[k] != (key[k - 1] if k > 0 else last)), to)
                    if to == at:
                        yield one(held)
                        held, rows = [], 0
                        to = len(key)
                held.append(batch.slice(at, to - at))
                rows += to - at
                at = to
            last = key[-1] if key else last
        if held:
            yield one(held)

    def one(held):
        table = pa.Table.from_batches(held)
        column = lambda n: table.column(n).to_numpy()
        group = np.zeros(table.num_rows, np.int64)
        for n in names:
            values = column(n) if n != "label" else table.column(n).combine_chunks().dictionary_encode().indices.to_numpy()
            group = np.append(0, np.cumsum((np.diff(group) != 0) | (np.diff(values) != 0)))
        lists = [np.asarray(v, np.int64) for v in table.column("directions").to_pylist()]
        ids, links, root = linked(group, column("direction"), column("rep"), column("copies"), matrix(table.column("embedding").to_pylist(), width), lists, column("side"), least)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(root)], names=["rep", "links", "root"])

    dealt = cells.select(*names, "side", "rep", "copies", "embedding", "directions").repartition(parts_n, *names).sortWithinPartitions(*names)
    links = stored(dealt.mapInArrow(compare, "rep long, links long, root long"))
    found = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.join(counts, "rep", "left").join(found, "rep", "left").withColumn("root", F.coalesce("component", "rep"))
    known = known.join(known.groupBy("root").agg(F.min("low").alias("component_id")), "root")
    known = known.select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.join(known, ["label", "embedding"], "left")
    # a row without an id has the vector of others at most: it isn't one of those that were counted
    alone = F.col("n_links").isNull() | F.col("vec_id").isNull()
    out = out.select("vec_id", F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"), F.when(alone, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_caps(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.93)


#: All links, found or not: for small tables, where none is missed.
OP9_SQL = """
with recursive rows as (
  select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
fit as (
  select r, vec_id, label, v, sqrt(list_dot_product(v, v)) as norm from rows
  where label is not null and vec_id is not null and v is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
links as (select a.r as a, b.r as b from fit a join fit b on a.label = b.label and a.r <> b.r where list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
reach as (select r, r as other from rows union select reach.r, links.b from reach join links on links.a = reach.other),
roots as (select reach.r, min(o.vec_id) as component_id from reach join rows o on o.r = reach.other group by reach.r),
counts as (select a as r, count(*) as n from links group by a)
select rows.vec_id, coalesce(counts.n, 0) as n_links, component_id, rows.vec_id = component_id as kept
from rows join roots using (r) left join counts using (r)
"""

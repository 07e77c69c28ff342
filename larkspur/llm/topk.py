"""Exact top-k search by inner product: the threshold algorithm over sorted lists per dimension.

Rows are dealt into cells by the nearest of a bounded number of pivots, and large cells into blocks of
about CANDIDATES rows. A block has, for each dimension, its rows in order of that component. All its
queries go down these lists together, from both ends, each list down to the value that weighs as much as
those reached in the others; rows met are scored, and a query stops when the best score that an unmet
row could have is below its k-th. That bound takes the components that unmet rows can still have and the
largest norm that they have.

Queries are searched in a block of their own cell first. The k-th score found there is carried to all
others: a query goes only to cells whose own bound, from the ranges of their components and norms,
reaches it, and there the lists may stop before a row is scored. Blocks keep only k rows for a query,
and those are merged. How much is pruned depends on the vectors, the result does not: where they point
in all directions alike no bound on components excludes a row, and every row is scored.

Cases: vectors that are null, or hold null or non-finite components, and rows without a vec_id take no
part; a shorter vector counts as filled up with zeros; ties go to the smaller id; rows that repeat an
id are candidates of their own, but none is a result for a query with its id, and queries with one id
share a list of the k best of all their products; with fewer than k others, all are given; other columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import again, stored

#: Rows of a block of candidates and of a block of queries; pivots at most; steps of the bound's search.
CANDIDATES, QUERIES, PIVOTS, STEPS = 8192, 2048, 512, (0.0, 0.25, 0.5, 0.75, 1.0, 1.5)


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def whole(vectors: pd.Series, width: int) -> np.ndarray:
    """floor(64 x) of each component, as whole numbers in float64."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = np.floor(64 * np.asarray(v, np.float64))
    return out


def highest(queries: np.ndarray, low: np.ndarray, high: np.ndarray, norm: float) -> np.ndarray:
    """For each query, a bound of its product with any x of low <= x <= high and |x| <= norm: for every
    t >= 0 the sum of the largest q x - t x x / 2 of each component, and t norm norm / 2, is one."""
    out = np.full(len(queries), np.inf)
    own = np.sqrt((queries**2).sum(1, keepdims=True)) / max(norm, 1e-300)
    for step in STEPS:
        t = step * own
        best = np.where(t > 0, queries / np.where(t > 0, t, 1), np.where(queries > 0, high, low))
        x = np.clip(best, low, high)
        out = np.minimum(out, (queries * x - t * x * x / 2).sum(1) + t[:, 0] * norm * norm / 2)
    return out + 1e-9 * np.abs(out) + 1e-6


def search(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, known: np.ndarray | None = None, scored: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(query, id, score) of the k best rows for each query, those with its id left out. known: scores
    that k other rows reach for each query; rows below may be left out. scored: gets the products made."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    n, width = rows.shape
    known = np.full(len(queries), -np.inf) if known is None else known
    exact = np.abs(rows).max(initial=0) * np.abs(queries).max(initial=0) * max(width, 1) * (n + 1) < 2.0**52
    # beyond what float64 holds exactly, products are made of Python's whole numbers
    of, by = (rows, queries) if exact else (np.array([[int(x) for x in r] for r in m], object).reshape(m.shape) for m in (rows, queries))
    # Sorted access: the lists of all dimensions, from both ends, by how much a value weighs for these
    # queries. A row is met in the list where it stands highest, and every list is read down to one level.
    weight = np.maximum(np.sqrt((queries**2).mean(0)) if len(queries) else np.ones(width), 1e-9)
    level = (np.abs(rows) * weight).max(1, initial=0)
    by_met = np.argsort(-level, kind="stable")
    level = level[by_met]
    least, most = rows.min(0, initial=0), rows.max(0, initial=0)
    norms = np.sqrt((rows[by_met] ** 2).sum(1))
    norms = np.maximum.accumulate(norms[::-1])[::-1]  # the largest of the rows not met before
    best = np.full((len(queries), k), -np.inf, of.dtype)  # keys: score * n + (n - 1 - place), so that ties go to smaller ids
    active = np.arange(len(queries))
    at, step = 0, 0
    while len(active) and at < n:
        reach = level[at] / weight  # no row that wasn't met has a component beyond it
        bound = highest(queries[active], np.maximum(least, -reach), np.minimum(most, reach), norms[at])
        kth = np.maximum(best[active].min(1).astype(float) / n - 1, known[active])  # a key is less than its score and one, n times
        active = active[~(kth > bound)]
        step = 2 * step if step else 2 * k
        to = min(n, at + step)
        new = by_met[at:to]
        at = to
        if len(new) and len(active):
            keys = (by[active] @ of[new].T) * n + (n - 1 - new)
            keys[query_ids[active][:, None] == ids[new]] = -np.inf
            if scored is not None:
                scored.append(keys.size)
            keys = np.concatenate([best[active], keys], 1)
            best[active] = -(np.partition(-keys, k - 1, axis=1) if exact else np.sort(-keys, axis=1))[:, :k]
    out = []
    for q, keys in zip(query_ids.tolist(), best, strict=True):
        for key in sorted((int(x) for x in keys if x != -np.inf), reverse=True):
            out.append((q, int(ids[n - 1 - key % n]), key // n))
    return out


def celled(rows: DataFrame, width: int, n: int) -> tuple[DataFrame, pd.DataFrame]:
    """rows with the cell of their nearest pivot, stored, and for each cell its rows, the lowest and highest
    value of each component and the largest norm: one line for each of PIVOTS pivots at most. Pivots are
    the rows of lowest hash, about one for a block."""
    many = min(PIVOTS, max(1, -(-n // CANDIDATES)))
    pivots = whole([r["embedding"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(many).collect()], width)
    pivots = pivots / np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-300)

    def nearest(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = whole(b.column("embedding").to_pylist(), width)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((x @ pivots.T).argmax(1).astype(np.int32))], names=[*b.schema.names, "cell"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    out = stored(rows.mapInArrow(nearest, f"{kinds}, cell int"))

    def ranges(batches):
        held: dict[int, list] = {}
        for b in batches:
            x, cell = whole(b.column("embedding").to_pylist(), width), b.column("cell").to_numpy()
            for c in np.unique(cell).tolist():
                own = x[cell == c]
                new = [len(own), own.min(0), own.max(0), float(np.sqrt((own**2).sum(1)).max())]
                old = held.get(c, new)
                held[c] = new if old is new else [old[0] + new[0], np.minimum(old[1], new[1]), np.maximum(old[2], new[2]), max(old[3], new[3])]
        if held:
            yield pa.RecordBatch.from_pydict({"cell": pa.array(held, pa.int32()), "n": pa.array([v[0] for v in held.values()], pa.int64()), "low": pa.array([v[1].tolist() for v in held.values()], pa.list_(pa.float64())), "high": pa.array([v[2].tolist() for v in held.values()], pa.list_(pa.float64())), "norm": pa.array([v[3] for v in held.values()], pa.float64())})

    found = out.select("embedding", "cell").mapInArrow(ranges, "cell int, n long, low array<double>, high array<double>, norm double")
    every = [F.array(*(f(F.col(c)[i]) for i in range(width))).alias(c) for c, f in (("low", F.min), ("high", F.max))]
    return out, found.groupBy("cell").agg(F.sum("n").alias("n"), *every, F.max("norm").alias("norm")).toPandas()


def top_k(vectors: DataFrame, queries: Column, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of vectors (vec_id, embedding) for each
    row for which `queries` holds."""
    rows = vectors.select("vec_id", "embedding", queries.alias("is_query")).where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    if not size["n"]:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = size["d"]
    rows, cells = celled(rows, width, size["n"])
    blocks = {c: max(1, -(-n // CANDIDATES)) for c, n in zip(cells["cell"].tolist(), cells["n"].tolist(), strict=True)}
    block_of = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair]) if blocks else F.create_map(F.lit(0), F.lit(1))
    block = F.pmod(F.xxhash64("vec_id"), F.element_at(block_of, F.col("cell"))).cast("int")
    left = rows.select("vec_id", "embedding", "cell", block.alias("block"))
    asked = again(rows).where("is_query").select("vec_id", "embedding", "cell", block.alias("block"))

    def found(c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        hits = search(c["vec_id"].to_numpy(), whole(c["embedding"], width), q["vec_id"].to_numpy(), whole(q["embedding"], width), k, q["known"].to_numpy(float)) if len(c) and len(q) else []
        return pd.DataFrame(hits, columns=["query_id", "vec_id", "score"]).astype("int64")

    def searched(asked: DataFrame) -> DataFrame:
        """The best rows of each block for the queries that go there; queries of a block in groups."""
        groups = asked.groupBy("cell", "block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups"))
        right = asked.join(groups, ["cell", "block"]).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("groups")).cast("int"))
        there = left.join(groups, ["cell", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        keys = ["cell", "block", "part"]
        return there.select(*keys, "vec_id", "embedding").groupBy(*keys).cogroup(right.select(*keys, "vec_id", "embedding", "known").groupBy(*keys)).applyInPandas(found, "query_id long, vec_id long, score long")

    def merged(hits: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return hits.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)

    first = stored(searched(asked.withColumn("known", F.lit(float("-inf")))))
    if sum(blocks.values()) <= 1:
        return merged(first)
    kth = merged(first).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("known"))
    asked = asked.join(kth, "vec_id", "left").withColumn("known", F.coalesce("known", F.lit(float("-inf"))))
    low, high = (np.array(cells[c].tolist(), float).reshape(len(cells), width) for c in ("low", "high"))
    order, norms, counts = cells["cell"].to_numpy(), cells["norm"].to_numpy(), np.array(list(blocks.values()))

    def others(batches):
        """A row for each block that a query must still see."""
        for b in batches:
            x, known = whole(b.column("embedding").to_pylist(), width), b.column("known").to_numpy()
            for i in range(0, len(x), 256):
                reach = np.stack([highest(x[i : i + 256], low[c], high[c], norms[c]) for c in range(len(order))], 1) >= known[i : i + 256, None]
                q, c = np.nonzero(reach)
                at = np.repeat(np.arange(len(q)), counts[c])
                number = np.arange(len(at)) - np.repeat(counts[c].cumsum() - counts[c], counts[c])
                cell, q = order[c[at]], q[at] + i
                new = (cell != b.column("cell").to_numpy()[q]) | (number != b.column("block").to_numpy()[q])
                q = pa.array(q[new])
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(q), b.column("embedding").take(q), pa.array(cell[new].astype(np.int32)), pa.array(number[new].astype(np.int32)), b.column("known").take(q)], names=["vec_id", "embedding", "cell", "block", "known"])

    kind = rows.schema["embedding"].dataType.simpleString()
    more = asked.select("vec_id", "embedding", "cell", "block", "known").mapInArrow(others, f"vec_id long, embedding {kind}, cell int, block int, known double")
    return merged(first.unionAll(searched(more)))


def op8_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20)


OP8_SQL = """
with rows as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
  from embeddings where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
  from rows q join rows c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 20
"""

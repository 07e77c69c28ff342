"""Substring dedup: prefix-partitioned suffix trees, cut at a depth of WINDOW words.

In a suffix tree of all texts the inner nodes of depth WINDOW or more are the repeats. The tree is
split by prefixes into subtrees that fit in memory:

1. Of the suffixes only sampled ones are kept: each window of WINDOW words chooses the smallest hash
   of its PREFIX-word prefixes, so equal windows choose the same place, and a sampled suffix stands
   for the run of windows that chose it. The chosen PREFIX words are its prefix, the run's words are
   its span. Spans that occur twice or more are repeats as a whole; spans that many documents of a
   sample hold are known to be, and are decided where they stand.
2. A prefix that several different spans share is a node that must be looked into. The spans go to
   the prefix's group. Where a group's spans have more than MOST words, its prefixes are made longer
   by PREFIX words, to the right where all of the window's words allow it and else to the left, until
   the groups fit. A window that is still in too large a group at three times PREFIX is told apart by
   all of its words, and counted with partial sums.
3. A group's subtree is built in memory: its suffixes get the ranks of their first 1, 2, 4, ... words
   up to WINDOW, that is, their nodes at these depths. Nodes of depth WINDOW with two leaves or more
   are the repeats that only parts of spans have.

A frequent prefix (a sample shows which) is never brought together before it is split: its spans
are counted with partial sums and found again by a join that Spark can split. Words are told apart
by 64-bit hashes; links between documents are never listed.

Cases: a null text has no words; texts shorter than a window lose nothing; windows repeat within a
document as well as between documents; rows with null or repeated ids are judged each for itself,
as doc_id plays no part (a number of the row does); a document may lose all its words and then has
an empty text; a very long text is hashed in pieces, but its words' hashes are held by one task at a
time; an empty table gives no rows; other columns are kept as they are, but for those that this
operator adds, which replace columns with their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP, U64, buckets, flat, gathered, hot_keys, is_in, mix, numbered_texts, partitions, pieces, range_hash, routed, signed, stored, text_arrays, words

WINDOW, PREFIX = 35, 8
#: Words of a subtree's spans at most.
MOST = 1 << 19
ADDED = ["n_words", "n_removed", "kept"]


def runs(column: pa.Array, window: int = WINDOW, prefix: int = PREFIX):
    """For the texts' runs of windows with one chosen prefix: its hash, the hash of the run's span,
    the row, the first window (by word of the row), how many windows, and the prefix's place in the span."""
    data, offsets = text_arrays(column)
    _, _, h, at = words(data, offsets, False)
    n = len(h) - window + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 4
    value = np.zeros(len(h) - prefix + 1, np.uint64)
    for j in range(prefix):
        value += h[j : j + len(value)] * STEP[j]
    value = grams = mix(value)
    chosen, width, whole = np.arange(len(value)), 1, window - prefix + 1
    while width < whole:  # the smallest (leftmost) of width, then of twice as many, at last of all of a window
        shift = min(width, whole - width)
        less = value[shift:] < value[:-shift]
        value = np.where(less, value[shift:], value[:-shift])
        chosen = np.where(less, chosen[shift:], chosen[:-shift])
        width += shift
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
    fits = np.flatnonzero(np.arange(n) + window <= at[row + 1])
    chosen, row = chosen[fits], row[fits]
    new = np.ones(len(fits), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(fits)))
    start, place = fits[first], chosen[first] - fits[first]
    span = mix(range_hash(h, start, start + count - 1 + window) + place.astype(np.uint64))
    return grams[chosen[first]], span, row[first], start - at[row[first]], count, place


def joined_ranges(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of words from a up to b of each d, with those that touch joined."""
    order = np.lexsort((b, a, d))
    d, a, b = d[order], a[order], b[order]
    if not len(d):
        return d, a, b
    _, group = np.unique(d, return_inverse=True)
    far = int(b.max()) + 1  # ranges of one document lie apart from those of others
    end = np.maximum.accumulate(b + group * far) - group * far
    new = np.append(True, (d[1:] != d[:-1]) | (a[1:] > end[:-1]))
    first = np.flatnonzero(new)
    return d[first], a[first], end[np.append(first[1:], len(d)) - 1]


RANGES = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def range_lists(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The documents with ranges, and their joined ranges as lists."""
    d, a, b = joined_ranges(d, a, b)
    ids, first = np.unique(d, return_index=True)
    values = pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["a", "b"])
    return pa.array(ids), pa.ListArray.from_arrays(pa.array(np.append(first, len(d)).astype(np.int32)), values).cast(RANGES)


def leaves(spans: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The subtree of some spans: for each window the span, its place there, and how many windows
    have its node of depth `window`. Ranks of suffixes at depths 1, 2, 4, ... are the nodes."""
    size = np.array([len(s) for s in spans])
    start = size.cumsum() - size
    _, rank = np.unique(np.concatenate(spans), return_inverse=True)
    depth = 1
    while depth < window:
        shift = min(depth, window - depth)
        pair = rank[:-shift].astype(np.uint64) << U64(32) | rank[shift:].astype(np.uint64)
        _, rank = np.unique(pair, return_inverse=True)
        depth += shift
    many = size - window + 1
    of = np.repeat(np.arange(len(spans)), many)
    place = np.arange(len(of)) - np.repeat(many.cumsum() - many, many)
    node = rank[start[of] + place]
    return of, place, np.bincount(node)[node]


OPENED = "k long, d long, s int, kind int, o int, span binary"


def repeats(docs: DataFrame, key: str, size: int, window: int = WINDOW, prefix: int = PREFIX, most: int = MOST) -> DataFrame:
    """(key, ranges): for documents with repeats, the words from a up to b of each. key: a column with
    a number for each row, the same whenever docs is read; size: bytes of all texts. Texts are brought to their runs with all other
    columns, so that the shuffle serves a later join of docs with the ranges as well."""
    if window < 4 * prefix - 1:
        raise ValueError("prefixes are too long for the window")
    whole_rows, docs = docs, docs.select(F.col(key).alias("doc_id"), "text")
    spark = docs.sparkSession

    def sample(batch):
        k, x, row, *_ = runs(batch.column("text"), window, prefix)
        return [np.unique(np.concatenate([k[row == i], x[row == i]])) for i in np.unique(row)]

    hot = spark.sparkContext.broadcast(hot_keys(docs, sample))
    # a run for each 14 words or so, in texts of 6 bytes a word or more
    many, parts = buckets(spark, size // 80)
    types = {"k": np.uint64, "x": np.uint64, "d": np.int64, "s": np.int32, "c": np.uint8, "o": np.uint8, "w": np.uint8}
    binaries = ", ".join(f"{n} binary" for n in types)
    inner = [("k", pa.int64()), ("x", pa.int64()), ("d", pa.int64()), ("s", pa.int32()), ("c", pa.int32()), ("o", pa.int32()), ("w", pa.int32())]
    fields = f"bucket int, {binaries}, rows array<struct<k: long, x: long, d: long, s: int, c: int, o: int, w: int>>, doc_id long, ranges array<struct<a: int, b: int>>"
    kinds = {"bucket": pa.int32(), **dict.fromkeys(types, pa.binary()), "rows": pa.list_(pa.struct(inner)), "doc_id": pa.int64(), "ranges": RANGES}

    def some(**columns):
        rows = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns.get(n, pa.nulls(rows, t)) for n, t in kinds.items()], names=list(kinds))

    def emit(batches):
        """Runs by the bucket of their prefix; those of frequent prefixes as rows; and the ranges of
        frequent spans, of which only the task's first occurrence goes on, with the weight of two."""
        told: set[int] = set()
        for b in pieces(batches):
            k, x, row, s, c, o = runs(b.column("text"), window, prefix)
            d, w = b.column("doc_id").to_numpy()[row], np.ones(len(k), np.uint8)
            known = is_in(hot.value, x)
            if known.any():
                ids, lists = range_lists(d[known], s[known], (s + c - 1 + window)[known])
                yield some(doc_id=ids, ranges=lists)
                _, at = np.unique(x[known], return_index=True)
                at = [i for i in np.flatnonzero(known)[at].tolist() if int(x[i]) not in told]
                told.update(x[at].tolist())
                w[at] = 2
                left = np.flatnonzero(~known | (w == 2))
                k, x, d, s, c, o, w = (v[left] for v in (k, x, d, s, c, o, w))
            late = is_in(hot.value, k)
            if not late.all():
                own = ~late
                sent = routed(k[own], [v[own].astype(t) for v, t in zip((k, x, d, s, c, o, w), types.values(), strict=True)], many, list(types))
                yield some(**dict(zip(sent.schema.names, sent.columns, strict=True)))
            if late.any():
                values = pa.StructArray.from_arrays([pa.array(signed(v[late])) if v.dtype == np.uint64 else pa.array(v[late].astype(np.int64)).cast(t) for v, (_, t) in zip((k, x, d, s, c, o, w), inner, strict=True)], names=[n for n, _ in inner])
                yield some(rows=pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values).cast(kinds["rows"]))

    sent = stored(docs.mapInArrow(emit, fields))

    def group(batches):
        """kind 0: all of the run is a repeat; 1: its windows must be looked at one by one; 2: the
        same for one run of a span that is known to repeat."""
        got = gathered(batches, types)
        order = np.lexsort((got["s"], got["d"], got["x"], got["k"]))
        k, x, d, s, c, o, w = (got[n][order] for n in types)
        if not len(k):
            return
        new_k = np.append(True, k[1:] != k[:-1])
        new_x = new_k | np.append(True, x[1:] != x[:-1])
        of_k, of_x = new_k.cumsum() - 1, new_x.cumsum() - 1
        twice = np.bincount(of_x, w)[of_x] > 1
        several = (np.bincount(of_k, new_x) > 1) & (np.bincount(of_k, ~twice) > 0)
        split = several[of_k]
        for kind, keep in ((0, twice), (1, split & ~twice), (2, split & twice & new_x)):
            yield pa.RecordBatch.from_arrays([pa.array(signed(k[keep])), *(pa.array(v[keep].astype(t)) for v, t in ((d, np.int64), (s, np.int32), (c, np.int32), (o, np.int32))), pa.array(np.full(keep.sum(), kind, np.int32))], names=["k", "d", "s", "c", "o", "kind"])

    run = "k long, d long, s int, c int, o int, kind int"
    cold = sent.where("bucket is not null").select("bucket", *types).repartition(parts, "bucket").drop("bucket").mapInArrow(group, run)
    warm = sent.where("rows is not null").select(F.explode("rows").alias("r")).select("r.*")
    spans = warm.groupBy("k", "x").agg(F.sum("w").alias("m"), F.min(F.struct("d", "s", "c", "o")).alias("r"))
    whole = warm.join(spans.where("m > 1").select("k", "x"), ["k", "x"], "left_semi").select("k", "d", "s", "c", "o", F.lit(0).alias("kind"))
    found = stored(cold.unionAll(whole).unionAll(spans.select("k", "r.d", "r.s", "r.c", "r.o", F.when(F.col("m") > 1, 2).otherwise(1).alias("kind"))), size // 80)

    def take(batches):
        """The spans' words of all runs that must be looked into."""
        for b in pieces(batches):
            data, offsets = text_arrays(b.column("text"))
            _, _, h, at = words(data, offsets, False)
            own = b.column("__own")
            r = own.flatten()
            of = np.repeat(np.arange(b.num_rows), pc.list_value_length(own).to_numpy())
            k, s, c, o, kind = (r.field(n).to_numpy() for n in ("k", "s", "c", "o", "kind"))
            first = at[of] + s
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(b.column(key).to_numpy()[of]), pa.array(s), pa.array(kind), pa.array(o), flat([h[i : i + n - 1 + window] for i, n in zip(first.tolist(), c.tolist(), strict=True)])], names=["k", "d", "s", "kind", "o", "span"])

    own = found.where("kind > 0").groupBy(F.col("d").alias(key)).agg(F.collect_list(F.struct("k", "s", "c", "o", "kind")).alias("__own"))
    opened = whole_rows.join(own, key).mapInArrow(take, OPENED)
    sizes = found.where("kind > 0").groupBy("k").agg(F.sum(F.col("c") - 1 + window).alias("size"))
    ranges = found.where("kind = 0").select(F.col("d").alias("doc_id"), F.col("s").alias("a"), (F.col("s") + F.col("c") - 1 + window).cast("int").alias("b"))
    for table, total in fitting(opened, sizes, window, prefix, most):
        ranges = ranges.unionAll(repeated_windows(table, window) if total is None else repeated_nodes(table, total, window, most))
    lists = ranges.select("doc_id", F.array(F.struct("a", "b")).alias("ranges")).unionAll(sent.where("doc_id is not null").select("doc_id", "ranges"))
    return lists.groupBy(F.col("doc_id").alias(key)).agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def fitting(opened: DataFrame, sizes: DataFrame, window: int, prefix: int, most: int):
    """(spans, their words) whose groups (k) have at most `most` words each, split by longer prefixes
    where they must be; then, with None, single windows, whose groups are nodes. sizes: words of groups."""
    for length in (prefix, 2 * prefix, 3 * prefix):
        total, over = sizes.agg(F.sum("size"), F.count_if(F.col("size") > most)).first()
        if not over:
            yield opened, total or 0
            return
        large = stored(sizes.where(F.col("size") > most).select("k"), over)
        yield opened.join(large, "k", "left_anti"), total
        last = length == 3 * prefix
        opened = stored(opened.join(large, "k", "left_semi").mapInArrow(lambda batches, n=length, last=last: longer(batches, n, window, prefix, last), OPENED))
        sizes = opened.groupBy("k").agg(F.sum(F.octet_length("span") / 8).cast("long").alias("size"))
    yield opened, None


def longer(batches, length: int, window: int, prefix: int, last: bool):
    """Spans under prefixes that are longer by `prefix` words: of a run's windows those that hold it to
    the right, and the others to the left. last: each window on its own, under all of its words."""
    for b in batches:
        rows = {n: [] for n in ("at", "s", "o", "from", "to", "span")}
        spans = [np.frombuffer(x, np.uint64) for x in b.column("span").to_pylist()]
        for i, (span, o, s) in enumerate(zip(spans, b.column("o").to_pylist(), b.column("s").to_pylist(), strict=True)):
            many = len(span) - window + 1
            if last:
                new = [(w, w + window, 0, window) for w in range(many)]
            else:
                right = min(many, max(0, o + length + prefix - window))  # the first window that reaches so far
                new = [(0, right - 1 + window, o - prefix, o + length)] if right else []
                new += [(right, len(span), o - right, o - right + length + prefix)] if right < many else []
            for a, e, start, end in new:
                part = span[a:e]
                for n, v in zip(rows, (i, s + a, start, start, end, part), strict=True):
                    rows[n].append(v)
        if not rows["at"]:
            continue
        size = np.array([len(p) for p in rows["span"]])
        first = size.cumsum() - size
        k = range_hash(np.concatenate(rows["span"]), first + np.array(rows["from"]), first + np.array(rows["to"]))
        at = np.array(rows["at"])
        body = [np.zeros(0, np.uint64)] * len(at) if last else rows["span"]
        yield pa.RecordBatch.from_arrays([pa.array(signed(mix(k + U64(length)))), b.column("d").take(pa.array(at)), pa.array(rows["s"], pa.int32()), b.column("kind").take(pa.array(at)), pa.array(rows["o"], pa.int32()), flat(body)], names=["k", "d", "s", "kind", "o", "span"])


def repeated_windows(node: DataFrame, window: int) -> DataFrame:
    """(doc_id, a, b): the words of windows of kind 1 whose node has another leaf, by partial sums."""
    twice = node.groupBy("k").agg(F.sum("kind").alias("m"), F.min("kind").alias("least")).where("m > 1 and least = 1").select("k")
    return node.where("kind = 1").join(twice, "k", "left_semi").select(F.col("d").alias("doc_id"), F.col("s").alias("a"), (F.col("s") + window).cast("int").alias("b"))


def repeated_nodes(opened: DataFrame, total: int, window: int, most: int) -> DataFrame:
    """(doc_id, a, b): the words of windows of kind 1 whose node has two leaves or more, by subtrees of
    `total` words."""

    def build(batches):
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for b in batches:
            k, length = b.column("k").to_numpy(), pc.binary_length(b.column("span")).to_numpy() // 8
            at = 0
            while at < len(k):  # whole groups, until they have `most` words
                border = np.flatnonzero(k[at:] != np.append(k[at] if last is None else last, k[at:-1])) + at
                total = size + np.cumsum(length[at:]) - length[at:]
                cut = border[total[border - at] >= most]
                to = int(cut[0]) if len(cut) else len(k)
                if to > at:
                    held.append(b.slice(at, to - at))
                    size += int(length[at:to].sum())
                    last = k[to - 1]
                if len(cut):
                    yield tree(held)
                    held, size, last = [], 0, None
                at = to
        if held:
            yield tree(held)

    def tree(held):
        table = pa.Table.from_batches(held)
        d, s, kind = (table.column(n).to_numpy() for n in ("d", "s", "kind"))
        of, place, times = leaves([np.frombuffer(x, np.uint64) for x in table.column("span").to_pylist()], window)
        keep = (times > 1) & (kind[of] == 1)
        a = s[of[keep]] + place[keep]
        ids, a, b = joined_ranges(d[of[keep]], a.astype(np.int64), a.astype(np.int64) + window)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["doc_id", "a", "b"])

    n = max(partitions(opened.sparkSession), -(-total // (4 * MOST)))
    dealt = opened.select("k", "d", "s", "kind", "span").repartition(n, "k").sortWithinPartitions("k")
    return dealt.mapInArrow(build, "doc_id long, a int, b int")


def strip(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, most: int = MOST) -> DataFrame:
    """All columns of docs with n_words, n_removed and kept: the words that no repeat covers, joined
    by one space. Columns of docs with these names are replaced."""
    docs = docs.drop(*ADDED)
    names, fields = docs.columns, [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    docs, size = numbered_texts(docs, "__row")
    docs = docs.where("__row is not null")  # which an inner join would add: both joins read one shuffle
    joined = docs.join(repeats(docs, "__row", size, window, prefix, most).withColumnRenamed("ranges", "__ranges"), "__row", "left").select(*(F.col(f"`{n}`") for n in names), "__ranges")

    def rows(batches):
        for b in pieces(batches):
            total, removed, kept = [], [], []
            for text, ranges in zip(b.column("text").to_pylist(), b.column("__ranges").to_pylist(), strict=True):
                own = (text or "").encode().split()
                total.append(len(own))
                if ranges:
                    keep = np.zeros(len(own) + 1, np.int64)
                    np.add.at(keep, [r["a"] for r in ranges], 1)
                    np.add.at(keep, [r["b"] for r in ranges], -1)
                    own = [own[i] for i in np.flatnonzero(keep[:-1].cumsum() == 0).tolist()]
                removed.append(total[-1] - len(own))
                kept.append(b" ".join(own).decode())
            yield pa.RecordBatch.from_arrays([*(b.column(f) for f in names), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[*names, *ADDED])

    return joined.mapInArrow(rows, ", ".join([*fields, "n_words long", "n_removed long", "kept string"]))


def op5_substring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return strip(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
with rows as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
starts as (select r, w, unnest(range(1, len(w) - 33)) as i from rows where len(w) >= 35),
repeated as (select r, i from (select r, i, array_to_string(w[i:i + 34], ' ') as x from starts) qualify count(*) over (partition by x) > 1),
covered as (select distinct r, unnest(range(i, i + 35)) as i from repeated),
words as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from rows),
kept as (select r, string_agg(word, ' ' order by i) as text, count(*) as n from words anti join covered using (r, i) group by r)
select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from rows left join kept using (r)
"""

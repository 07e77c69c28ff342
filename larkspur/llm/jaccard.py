"""N-gram Jaccard join: a prefix join whose candidate sets are verified in a trie.

A document's set holds the hashes of its distinct word n-grams, in the order of the hashes. N-grams
that a sample of documents shows to be frequent come after all others in that order, so that passages
which many documents share don't bring unlike documents together. A set routes its prefix: so many of
its first n-grams that what is left can't hold all of the overlap that a link needs, so linked sets
share a routed n-gram (the prefix filter). Sets that could link by frequent n-grams alone route all
their rare ones, and a prefix of the frequent ones by which a pair that shares no rare one is bounded
before it is made.

As hashes are random, far less than a prefix does for large sets: of a link's rare parts, which have a
similarity that follows from the frequent share, n first hashes have none in common with a chance that
falls with the power of n. Where `miss` is given, only as many are routed as bring that chance below it
(1e-14 by default: 64-bit hashes of n-grams are likelier to collide); with None, whole prefixes are,
and nothing is left to chance. N-grams that only one distinct set holds go no further. What is left is
joined in rounds:

1. twice, every set is paired with one other, of those that its n-grams' groups have as their centre
   the one met most often (linear in the group; first the centre with the fewest rare n-grams, then
   one by a hash); pairs are pruned by sizes and by bitmaps, whose
   difference bounds the sets' difference from below, and verified exactly; links give components;
2. n-grams that still join more than one component pair the sets outside of the n-gram's largest
   component with those of other components, a pair once for its frequent n-grams; pairs are pruned
   and verified in the same way. Sets of one component don't meet again.

So copies and near copies of one text are never expanded into all pairs, and no link between
components is lost. In verification the sets of the candidates of one document are stored in one
order with their common prefixes (a radix trie); the overlap counted along a shared prefix is used
by all sets below it, and a branch is left as soon as what remains can't reach the overlap needed.

Cases: a null text and one without words have an empty set, which links with nothing; a text with
fewer than n words is one n-gram; equal sets link (repeated rows, too); rows with null or repeated ids
are judged each for itself, under a number of the row, and a null id is never the smallest of a group
unless all its ids are null; a very long text is hashed in pieces, but its set is held by one task at a
time; an empty table gives no rows; columns other than doc_id and text play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, buckets, components, dropped, flat, gathered, hot_keys, is_in, mix, numbered_texts, pieces, routed, shingle_sets, signed, stored

#: Candidates of one document that are verified together; rounds of centres; a row with a text or a
#: set's n-grams counts as so many narrow ones in the size of a file.
BLOCK, ROUNDS, WIDE = 64, 2, 10
#: Chance of a linked pair not to meet; the share of frequent n-grams from which they are routed, too.
MISS, MOSTLY = 1e-14, 0.72


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """One bit for each n-gram's hash; twice to four times as many bits as n-grams, at least 64."""
    bits = max(64, 1 << int(2 * max(1, len(tokens)) - 1).bit_length())
    out = np.zeros(bits, bool)
    out[(tokens & U64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out)


def may_link(na: int, a: bytes, nb: int, b: bytes, num: int, den: int) -> bool:
    """False only if sizes or bitmaps rule out den * |A and B| >= num * |A or B|."""
    if den * min(na, nb) < num * max(na, nb):
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y, na, nb = y, x, nb, na
    folded = np.bitwise_or.reduce(y.reshape(-1, len(x)), 0)
    need = -(-num * (na + nb) // (num + den))  # the least overlap of a link
    return int(np.bitwise_count(x & ~folded).sum()) <= na - need and int(np.bitwise_count(folded & ~x).sum()) <= nb - need


def trie_links(own: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[bool]:
    """Which sets link with own. Sets, sorted by their elements, are walked like a trie: overlap
    counts of a prefix that a set shares with the one before it are kept, and a walk stops when
    the overlap so far and the lengths that remain can't reach the overlap needed."""
    order = sorted(range(len(sets)), key=lambda i: sets[i].tobytes())
    out = [False] * len(sets)
    before = np.zeros(0, np.uint64)
    counts = np.zeros(1, np.int64)  # overlap with own after each element of the path walked so far
    for i in order:
        x = sets[i]
        need = -(-num * (len(own) + len(x)) // (num + den))
        m = min(len(before), len(x), len(counts) - 1)
        differ = np.flatnonzero(before[:m] != x[:m])
        at = int(differ[0]) if len(differ) else m
        counts = counts[: at + 1]
        step = max(32, len(x) // 8)
        while at < len(x):
            seen = int(np.searchsorted(own, x[at - 1], "right")) if at else 0
            if counts[at] + min(len(x) - at, len(own) - seen) < need:
                break
            part = x[at : at + step]
            counts = np.concatenate([counts, counts[at] + np.cumsum(is_in(own, part))])
            at += len(part)
        out[i] = at == len(x) and int(counts[at]) >= need and len(x) > 0
        before = x[:at]
    return out


def prefix_sizes(n: int, frequent: int, num: int, den: int) -> tuple[int, int]:
    """How many of a set's rare n-grams and of its frequent ones to route, of n of which `frequent` are.

    A link needs an overlap of num / den of n at least. Of the rare ones, as many must be in both as the
    frequent ones can't make up; sets that share so many share one of the first that leave out all but
    those. If the frequent ones can make up all, sets that share a rare one share one of all rare ones,
    and others share one of the first frequent ones, in the same way."""
    need = -(-num * n // den)
    if frequent < need:
        return n - need + 1, 0
    return n - frequent, frequent - need + 1


def sketch_sizes(n: int, frequent: int, num: int, den: int, miss: float) -> tuple[int, int]:
    """The same for a chance of `miss` at most, and never more than prefix_sizes.

    Of the union of a set and one linked to it at most 1 - t is not in both, and at least t - share is
    both rare and in both: the rare parts have a similarity of (t - share) / (1 - share) at least; n
    hashes miss a similarity j with a chance of (1 - j) ** n at most, and of two sets the one that
    routes less has the greater j. From MOSTLY on, the rare part is routed whole, and the frequent
    part for a similarity of t (if no rare n-gram is in both, t holds for the frequent parts)."""
    t, share, whole = num / den, frequent / n, prefix_sizes(n, frequent, num, den)
    need = lambda j: int(np.ceil(np.log(miss) / np.log(1 - j))) if j < 1 else 1
    if share >= min(MOSTLY, 0.96 * t):
        return n - frequent, min(need(t), whole[1])
    return min(need((t - share) / (1 - share)), whole[0]), 0


class Join:
    """The stages for one table of documents and one similarity num / den."""

    def __init__(self, rows: DataFrame, key: str, n: int, num: int, den: int, miss: float | None):
        """rows: the documents with a number of each row as key, here called doc_id; id: their own."""
        self.spark, self.n, self.num, self.den, self.miss = rows.sparkSession, n, num, den, miss
        self.docs = rows.select(F.col(key).alias("doc_id"), F.col("doc_id").alias("id"), "text")

    def digests(self) -> DataFrame:
        """For each document the size of its set, a 128-bit key of it, a bitmap, its routed n-grams and
        how many of the set are frequent."""
        n, num, den, miss = self.n, self.num, self.den, self.miss
        kind = self.docs.schema["id"].dataType.simpleString()
        hot = self.spark.sparkContext.broadcast(hot_keys(self.docs, lambda b: shingle_sets(b.column("text"), n), sample=40_000, least=4))

        def rows(batches):
            frequent = hot.value
            for batch in pieces(batches):
                sets = shingle_sets(batch.column("text"), n)
                cold, warm, reach = [], [], []
                for x in sets:
                    late = is_in(frequent, x)
                    reach.append(int(late.sum()))
                    first, second = 0, 0
                    if len(x):
                        first, second = sketch_sizes(len(x), reach[-1], num, den, miss) if miss else prefix_sizes(len(x), reach[-1], num, den)
                    cold.append(x[~late][:first])
                    warm.append(x[late][:second])
                keys = [np.array([mix(x).sum(), mix(x ^ U64(0x5851F42D4C957F2D)).sum()]) if len(x) else np.zeros(2, np.uint64) for x in sets]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("id"), pa.array([len(x) for x in sets], pa.int64()), *(pa.array(signed(np.array([k[i] for k in keys], np.uint64))) for i in (0, 1)), flat([bitmap(x) for x in sets]), flat(cold), flat(warm), pa.array(reach, pa.int64())], names=["doc_id", "id", "n", "k1", "k2", "bits", "cold", "warm", "reach"])

        return stored(self.docs.mapInArrow(rows, f"doc_id long, id {kind}, n long, k1 long, k2 long, bits binary, cold binary, warm binary, reach long"))

    def postings(self, own: DataFrame) -> DataFrame:
        """(token, doc_id, n, r) of all routed n-grams that more than one distinct set holds, or
        that are frequent; r: how much of the set can be in an overlap by which this n-gram pairs it
        (for a frequent one, of sets that share no rare one, the frequent part)."""
        many, parts = buckets(self.spark, (own.agg(F.sum(F.octet_length("cold"))).first()[0] or 0) // 8)
        fields = "token long, doc_id long, n long, r long"

        def emit(batches):
            for b in batches:
                for at in range(0, b.num_rows, 2048):
                    part = b.slice(at, 2048)
                    tokens = [np.frombuffer(x, np.uint64) for x in part.column("cold").to_pylist()]
                    size = [len(t) for t in tokens]
                    if sum(size):
                        k = np.concatenate(tokens)
                        yield routed(k, [k, np.repeat(part.column("doc_id").to_numpy(), size), np.repeat(part.column("n").to_numpy(), size).astype(np.int32)], many, ["k", "d", "n"])

        def meet(batches):
            got = gathered(batches, {"k": np.uint64, "d": np.int64, "n": np.int32})
            order = np.argsort(got["k"], kind="stable")
            k = got["k"][order]
            same = np.zeros(len(k) + 1, bool)
            same[1:-1] = k[1:] == k[:-1]
            keep = same[1:] | same[:-1]
            size = pa.array(got["n"][order][keep].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(signed(k[keep])), pa.array(got["d"][order][keep]), size, size], names=["token", "doc_id", "n", "r"])

        def warm(batches):
            for b in batches:
                tokens = [np.frombuffer(x, np.uint64) for x in b.column("warm").to_pylist()]
                size = [len(t) for t in tokens]
                if sum(size):
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(tokens))), *(pa.array(np.repeat(b.column(c).to_numpy(), size)) for c in ("doc_id", "n", "reach"))], names=["token", "doc_id", "n", "r"])

        cold = own.select("doc_id", "n", "cold").mapInArrow(emit, "bucket int, k binary, d binary, n binary").repartition(parts, "bucket").select("k", "d", "n").mapInArrow(meet, fields)
        return stored(cold.unionAll(own.where("length(warm) > 0").select("doc_id", "n", "reach", "warm").mapInArrow(warm, fields)))

    def sketches(self, own: DataFrame) -> DataFrame:
        """(doc_id, sketch): the routed frequent n-grams of each document that has some."""

        def rows(batches):
            for b in batches:
                tokens = [np.frombuffer(x, np.int64) for x in b.column("warm").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(tokens, pa.list_(pa.int64()))], names=["doc_id", "sketch"])

        return own.where("length(warm) > 0").select("doc_id", "warm").mapInArrow(rows, "doc_id long, sketch array<long>")

    def pruned(self, pairs: DataFrame, own: DataFrame, most: int | None = None) -> DataFrame:
        """Distinct pairs (a, b) that sizes and bitmaps don't rule out; most: of the pairs, if it is known."""
        num, den = self.num, self.den
        side = own.select("doc_id", "n", "bits")
        a = side.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba"))
        b = side.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb"))

        def rows(batches):
            for x in batches:
                keep = [may_link(*v, num, den) for v in zip(*(x.column(c).to_pylist() for c in ("na", "ba", "nb", "bb")), strict=True)]
                x = x.filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b")], names=["a", "b"])

        return stored(pairs.distinct().join(a, "a").join(b, "b").select("a", "b", "na", "ba", "nb", "bb").mapInArrow(rows, "a long, b long"), most)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link. Candidates a of one b are spread over blocks, each with b's text."""
        n, num, den = self.n, self.num, self.den
        need = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select(F.col("b").alias("doc_id"))).distinct()
        need = stored(need, 2 * pairs.count())
        texts = stored(self.docs.join(need, "doc_id", "left_semi"), WIDE * need.count())
        blocks = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        members = pairs.join(blocks, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int").alias("block"))
        members = members.join(texts.withColumnRenamed("doc_id", "a"), "a").select("b", "block", "a", "text", F.lit(1).alias("place"))
        centres = blocks.select("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(texts.withColumnRenamed("doc_id", "b"), "b")
        both = members.unionAll(centres.select("b", "block", F.col("b").alias("a"), "text", F.lit(0).alias("place")))
        dealt = both.repartition(self.wide(), "b", "block").sortWithinPartitions("b", "block", "place", "a")

        def rows(batches):
            centre, own, ids, sets = None, None, [], []

            def done():
                links = trie_links(own, sets, num, den) if ids else []
                found = [i for i, linked in zip(ids, links, strict=True) if linked]
                return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([centre] * len(found), pa.int64())], names=["a", "b"])

            for x in pieces(batches):
                for a, b, place, tokens in zip(x.column("a").to_pylist(), x.column("b").to_pylist(), x.column("place").to_pylist(), shingle_sets(x.column("text"), n), strict=True):
                    if not place:
                        if ids:
                            yield done()
                        centre, own, ids, sets = b, tokens, [], []
                    else:
                        ids.append(a)
                        sets.append(tokens)
                        if len(ids) >= 4 * BLOCK:
                            yield done()
                            ids, sets = [], []
            if ids:
                yield done()

        found = stored(dealt.mapInArrow(rows, "a long, b long"))
        dropped(texts)
        dropped(need)
        return found

    def wide(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def run(self) -> DataFrame:
        """row, doc_id, n_shingles, component_id, and whether the row is the first of its component."""
        num, den = self.num, self.den
        all_ = self.digests()
        low = F.struct(F.col("id").isNull().alias("none"), "id", F.col("doc_id").alias("row"))
        # only sets of several rows, and stored: then Spark can split the rows of one set in the join
        firsts = all_.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.min(low).alias("low"), F.count("*").alias("several"))
        total = all_.count()
        firsts = stored(firsts.where("several > 1").drop("several"), total)
        classes = all_.select("doc_id", "id", "n", "k1", "k2").join(firsts, ["k1", "k2", "n"], "left")
        classes = stored(classes.select("doc_id", "id", "n", F.coalesce("rep", "doc_id").alias("rep"), F.coalesce("low", low).alias("low")), total)
        own = stored(all_.join(classes.where("doc_id = rep and n > 0").select("doc_id"), "doc_id", "left_semi"), WIDE * total)
        dropped(all_)
        most = own.count()
        live = self.postings(own)
        rows = live.count()
        near = (F.lit(den) * F.least("na", "nb") >= F.lit(num) * F.greatest("na", "nb")) & (F.lit(num + den) * F.least("ra", "rb") >= F.lit(num) * (F.col("na") + F.col("nb")))
        marked, links, tried = live.withColumn("c", F.col("doc_id")), None, None
        for k in range(ROUNDS):
            by = F.xxhash64("doc_id", F.lit(k)) if k else F.struct(F.col("n") - F.col("r"), "doc_id")
            first = marked.groupBy("token").agg(F.min_by(F.struct("doc_id", "n", "r", "c"), by).alias("f"), F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
            star = marked.join(first, "token").where("c <> f.c").select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("r").alias("ra"), F.col("f.doc_id").alias("b"), F.col("f.n").alias("nb"), F.col("f.r").alias("rb")).where(near)
            star = star.groupBy("a", "b").count()
            if tried is not None:
                star = star.join(tried, ["a", "b"], "left_anti")
            pairs = stored(star.groupBy("a").agg(F.max_by("b", F.struct("count", "b")).alias("b")), most)
            tried = pairs if tried is None else tried.unionAll(pairs)
            new = self.verified(self.pruned(pairs, own, most))
            links = new if links is None else links.unionAll(new)
            before, marked = marked, stored(live.join(components(links).withColumnRenamed("node", "doc_id"), "doc_id", "left").select("token", "doc_id", "n", "r", F.coalesce("component", "doc_id").alias("c")), rows)
            if k:
                dropped(before)
        dropped(live)
        sizes = marked.groupBy("token", "c").count()
        mixed = sizes.groupBy("token").agg(F.max_by("c", F.struct("count", "c")).alias("big"), F.count("*").alias("several")).where("several > 1").select("token", "big")
        open_ = marked.join(mixed, "token").join(self.sketches(own), "doc_id", "left")
        open_ = stored(open_.withColumn("sketch", F.expr("if(array_contains(sketch, token), sketch, null)")))  # none for a rare one
        side = lambda k: [F.col(c).alias(c[0] + k) for c in ("doc_id", "n", "r", "c", "sketch")]
        x = open_.where("c <> big").select("token", "big", *side("a"))
        y = open_.select("token", *side("b"))
        once = F.coalesce(F.expr("array_min(array_intersect(sa, sb)) = token"), F.lit(True))
        rest = x.join(y, "token").where(near & F.expr("ca <> cb and (cb = big or da < db)") & once)
        rest = rest.select(F.greatest("da", "db").alias("a"), F.least("da", "db").alias("b"))
        tried = tried.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        links = links.unionAll(self.verified(self.pruned(rest.join(tried, ["a", "b"], "left_anti"), own)))
        found = components(links).withColumnRenamed("node", "rep")
        each = classes.where("doc_id = rep").join(found, "rep", "left").select("rep", F.coalesce("component", "rep").alias("root"), "low")
        lows = each.join(each.groupBy("root").agg(F.min("low").alias("least")), "root").select("rep", "least")
        out = classes.join(lows, "rep").select(F.col("doc_id").alias("row"), F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("least.id").alias("component_id"), (F.col("least.row") == F.col("doc_id")).alias("first"))
        out = stored(out)
        for old in (own, marked, open_):
            dropped(old)
        return out


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 75, den: int = 100, miss: float | None = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id of documents whose n-gram sets link at num / den or more."""
    rows, _ = numbered_texts(docs.select("doc_id", "text"), "row")
    found = Join(rows, "row", n, num, den, miss).run().select("doc_id", "n_shingles", "component_id")
    dropped(rows)
    return found


def first_documents(docs: DataFrame, n: int = 5, num: int = 75, den: int = 100, miss: float | None = MISS) -> DataFrame:
    """The rows of docs, with all their columns, but of each component only the one with the smallest id."""
    rows, _ = numbered_texts(docs, "__row")
    first = Join(rows, "__row", n, num, den, miss).run().where("first").select(F.col("row").alias("__row"))
    return rows.join(first, "__row", "left_semi").drop("__row")


def op1_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All links and all that they reach, for small tables.
OP1_SQL = r"""
with recursive rows as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
each as (select r, unnest(range(1, greatest(len(w) - 3, 2))) as i from rows where len(w) > 0),
sets as (select distinct r, array_to_string(w[i:i + 4], ' ') as s from each join rows using (r)),
sizes as (select r, count(*) as n from sets group by r),
shared as (select a.r as a, b.r as b, count(*) as c from sets a join sets b on a.s = b.s and a.r <> b.r group by all),
links as (select a, b from shared join sizes x on x.r = a join sizes y on y.r = b where 100 * c >= 75 * (x.n + y.n - c)),
reach as (select r, r as other from rows union select reach.r, links.b from reach join links on links.a = reach.other)
select rows.doc_id, coalesce(any_value(sizes.n), 0) as n_shingles, min(o.doc_id) as component_id
from rows left join sizes using (r) join reach using (r) join rows o on o.r = reach.other group by rows.r, rows.doc_id
"""

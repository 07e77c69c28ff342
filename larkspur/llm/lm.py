"""Language-model scoring: a log-bilinear neural model trained with noise-contrastive estimation.

Counts of all training tokens come first: each task counts its words, the counts meet by hash in
buckets, and every word counted LEAST times or more becomes part of the model's vocabulary, which
so grows with the corpus (up to VOCABULARY words, as it is broadcast; beyond, the count asked for rises,
and the words left out are told apart by their counts, as rarer words are). The probability of a word is that of its class after the class of the
word before, times the word's part of its class. The SINGLE most frequent words are a class each.
The others of the vocabulary are grouped by the words beside them, in as many classes as the root of
their number: sums of random vectors of all their neighbours meet in the word's bucket, and rounds
of spherical k-means over all these words, run where they lie, give the classes. Counts of pairs of
neighbouring classes over all training documents train the model: the vector of the previous class,
times a matrix, predicts the vector of the next one. Batched matrix products then give normalised
log-probabilities of every class after every class. A word of a class of the vocabulary has the part
of it that its count has. Words counted less share one class more and get their part
of it by how often they were counted: words seen r times share the weight that such words have
when one occurrence is held back (Good and Turing), and words never seen share that of words seen
once. Words of one class of counts split its weight by their own counts. So the probabilities of all
words, one unknown word and the end sum to one.

Vocabulary, counts and classes are broadcast (20 bytes a word, 84 MB at most); those of rarer words never: the
(word, document) pairs of rare words go to the word's bucket, which holds its count, and only sums
by document come back.

Cases: a null text counts as empty: it has the end token alone. Rows with repeated or null ids are
scored each for itself, equal ones alike. With no training token all words are unknown. A very long text
is hashed in blocks and scored whole by one task; an empty table gives no rows; other columns play no
part; words that are counted alike are told apart by their hashes alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import buckets, gathered, pieces, routed, stored, text_arrays, text_bytes, words

#: Words that are a class each, and how often a word of the vocabulary was counted at least; size of a
#: vector; noise samples for a pair, least steps, pairs of a step and rate of training; classes of counts.
SINGLE, LEAST, WIDTH, NOISE, STEPS, PAIRS, RATE, COUNTS = 1022, 20, 24, 16, 300, 2048, 0.05, 16
#: Words of the vocabulary at most: it is broadcast.
VOCABULARY = 1 << 22
#: Numbers that describe a word's neighbours, and rounds of grouping.
SIDES, ROUNDS = 12, 5
END = np.uint64(0x2545F4914F6CDD1D)


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's words and its end, and where each row begins."""
    data, offsets = text_arrays(batch.column("text"))
    _, _, h, at = words(data, offsets, True)
    n = len(offsets) - 1
    first = at + np.arange(n + 1)
    out = np.empty(len(h) + n, np.uint64)
    out[first[1:] - 1] = END
    inner = np.ones(len(out), bool)
    inner[first[1:] - 1] = False
    out[inner] = h
    return out, first


def count_words(docs: DataFrame, learning: Column) -> DataFrame:
    """(bucket, hash, count) of all training tokens as packed rows, a row for each bucket."""
    spark = docs.sparkSession
    many, n = buckets(spark, text_bytes(docs) // 6)

    def emit(batches):
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for b in pieces(batches):
            k, c = np.unique(tokens(b)[0], return_counts=True)
            seen.append((k, c))
            held += len(k)
            if held > 1_000_000:
                k, c = merged(seen)
                yield routed(k, [k, c], many, ["k", "c"])
                seen, held = [], 0
        if seen:
            k, c = merged(seen)
            yield routed(k, [k, c], many, ["k", "c"])

    def add(batches):
        got = gathered(batches, {"k": np.uint64, "c": np.int64})
        if len(got["k"]):
            k, c = merged([(got["k"], got["c"])])
            yield routed(k, [k, c], many, ["k", "c"])

    sent = docs.where(learning).select("text").mapInArrow(emit, "bucket int, k binary, c binary")
    return stored(sent.repartition(n, "bucket").select("k", "c").mapInArrow(add, "bucket int, k binary, c binary"))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    found, which = np.unique(keys, return_inverse=True)
    out = np.zeros(len(found), np.int64)
    np.add.at(out, which, counts)
    return found, out


def least_count(counted: DataFrame) -> int:
    """How often a word of the vocabulary was counted at least: LEAST times, or where more than VOCABULARY
    words are, the smallest power of two that leaves so many."""
    steps_ = [LEAST, *(1 << j for j in range(LEAST.bit_length(), 62))]

    def rows(batches):
        c = np.sort(gathered(batches, {"c": np.int64})["c"])
        yield pa.RecordBatch.from_arrays([pa.array([(len(c) - np.searchsorted(c, steps_)).tolist()], pa.list_(pa.int64()))], names=["n"])

    found = counted.select("c").mapInArrow(rows, "n array<long>").agg(*(F.coalesce(F.sum(F.col("n")[i]), F.lit(0)) for i in range(len(steps_)))).first()
    return next(step for step, n in zip(steps_, found, strict=True) if n <= VOCABULARY)


def summary(counted: DataFrame, least: int) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """All tokens, distinct ones, the vocabulary with its counts (sorted by hash), and for each
    count class the distinct words and tokens that aren't in it."""

    def rows(batches):
        got = gathered(batches, {"k": np.uint64, "c": np.int64})
        k, c = got["k"], got["c"]
        top = c >= least
        kinds = np.bincount(count_class(c), minlength=COUNTS)
        mass = np.bincount(count_class(c), c, minlength=COUNTS).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((int(c.sum()), pa.int64()), (len(c), pa.int64()), (k[top].tobytes(), pa.binary()), (c[top].tobytes(), pa.binary()), (kinds.tolist(), pa.list_(pa.int64())), (mass.tolist(), pa.list_(pa.int64())))], names=["n", "v", "k", "c", "kinds", "mass"])

    parts = counted.select("k", "c").mapInArrow(rows, "n long, v long, k binary, c binary, kinds array<long>, mass array<long>")
    part = stored(parts)
    sums = part.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v"), *(F.coalesce(F.sum(F.col(x)[i]), F.lit(0)).alias(f"{x}{i}") for x in ("kinds", "mass") for i in range(COUNTS))).first()

    def spread(batches):
        for b in batches:
            for k, c in zip(b.column("k").to_pylist(), b.column("c").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(k, np.int64)), pa.array(np.frombuffer(c, np.int64))], names=["k", "c"])

    best = part.select("k", "c").mapInArrow(spread, "k long, c long").toArrow()
    k, c = best.column("k").to_numpy().view(np.uint64), best.column("c").to_numpy()
    order = np.argsort(k)
    k, c = k[order], c[order]
    kinds = np.array([sums[f"kinds{i}"] for i in range(COUNTS)]) - np.bincount(count_class(c), minlength=COUNTS)
    mass = np.array([sums[f"mass{i}"] for i in range(COUNTS)]) - np.bincount(count_class(c), c, minlength=COUNTS).astype(np.int64)
    return sums["n"], sums["v"], k, np.stack([kinds, mass]), c


def count_class(c: np.ndarray) -> np.ndarray:
    """0: never, 1: once, 2: twice, then by powers of two."""
    return np.minimum(COUNTS - 1, np.ceil(np.log2(np.maximum(c, 1))).astype(int) + (c > 0))


def places(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Place of each token in the vocabulary; -1: not there."""
    if not len(known):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, -1)


def class_of(h: np.ndarray, first: np.ndarray, known: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each token (0: not in the vocabulary) and of the one before it, and its place."""
    at = places(h, known)
    classes = np.append(classes, 0)
    now = classes[at].astype(np.int64)
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[first[:-1]] = classes[places(np.array([END]), known)]
    return now, before, at


def word_classes(docs: DataFrame, learning: Column, n: int, known: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Class of each word of the vocabulary, from 1 on."""
    spark = docs.sparkSession
    classes = np.zeros(len(known), np.int32)
    single = np.sort(np.lexsort((known, -often))[:SINGLE])
    classes[single] = np.arange(1, len(single) + 1)
    rest = len(known) - len(single)
    if not rest:
        return classes
    groups = int(np.ceil(np.sqrt(rest)))
    # vectors of neighbours in whole numbers: their sums don't depend on the order; rarer ones weigh more
    weight = np.concatenate([[n - often[single].sum()], often[single]])
    sides = np.random.Generator(np.random.PCG64(11)).normal(0, 1 << 16, (2, len(weight), SIDES)) * np.sqrt(weight[1:].min() / np.maximum(weight, 1))[:, None]
    sides[:, 0] = 0
    sides = np.round(sides - (weight @ sides / weight.sum())[:, None, :]).astype(np.int64)
    shared = spark.sparkContext.broadcast((known, classes, sides))
    many, parts = buckets(spark, SIDES * rest)

    def emit(batches):
        words_, alone, (left, right) = shared.value
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for b in pieces(batches):
            now, before, at = class_of(*tokens(b), words_, alone)
            after = np.append(now[1:], 0)
            mine = np.flatnonzero((at >= 0) & (now == 0))
            if len(mine):
                seen.append(added(at[mine], left[before[mine]] + right[after[mine]]))
                held += len(seen[-1][0])
            if held > 200_000:
                at, f = added(*(np.concatenate(x) for x in zip(*seen, strict=True)))
                yield routed(words_[at], [words_[at], f], many, ["k", "f"])
                seen, held = [], 0
        if seen:
            at, f = added(*(np.concatenate(x) for x in zip(*seen, strict=True)))
            yield routed(words_[at], [words_[at], f], many, ["k", "f"])

    def add(batches):
        got = gathered(batches, {"k": np.uint64, "f": np.int64})
        if len(got["k"]):
            k, f = added(got["k"], got["f"].reshape(-1, SIDES))
            f = f / np.maximum(np.sqrt((f.astype(float) ** 2).sum(1, keepdims=True)), 1)
            yield routed(k, [k, np.round(f * (1 << 20)).astype(np.int64)], many, ["k", "f"])

    def held_by(batches):
        got = gathered(batches, {"k": np.uint64, "f": np.int64})
        return got["k"], got["f"].reshape(-1, SIDES)

    sent = docs.where(learning).select("text").mapInArrow(emit, "bucket int, k binary, f binary")
    described = stored(sent.repartition(parts, "bucket").select("k", "f").mapInArrow(add, "bucket int, k binary, f binary")).select("k", "f")
    columns = [f"f{i}" for i in range(SIDES)]
    schema = ", ".join(f"{x} long" for x in ("k", *columns))

    def table(k, f, name="k"):
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), *(pa.array(np.ascontiguousarray(x)) for x in f.T)], names=[name, *columns])

    def begin(batches):
        k, f = held_by(batches)
        first = np.argsort(k)[: groups]
        yield table(k[first], f[first])

    rows = described.mapInArrow(begin, schema).orderBy(F.xxhash64("k"), "k").limit(groups).select(*columns).toArrow()
    centre = np.stack([x.to_numpy() for x in rows.columns], 1).astype(float)
    for _ in range(ROUNDS):

        def move(batches, centre=centre):
            k, f = held_by(batches)
            if len(k):
                yield table(*added(nearest(f, centre), f))

        rows = described.mapInArrow(move, schema).groupBy("k").agg(*(F.sum(x).alias(x) for x in columns)).toArrow()
        centre[rows.column("k").to_numpy()] = np.stack([rows.column(x).to_numpy() for x in columns], 1)

    def last(batches):
        k, f = held_by(batches)
        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(nearest(f, centre).astype(np.int32))], names=["k", "g"])

    found = described.mapInArrow(last, "k long, g int").toArrow()
    used, group = np.unique(found.column("g").to_numpy(), return_inverse=True)
    classes[places(found.column("k").to_numpy().view(np.uint64), known)] = len(single) + 1 + group
    return classes


def added(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their rows."""
    order = np.argsort(keys, kind="stable")
    found, first = np.unique(keys[order], return_index=True)
    return found, np.add.reduceat(rows[order], first)


def nearest(f: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Row of centre in whose direction each row of f lies most."""
    unit = centre / np.maximum(np.sqrt((centre**2).sum(1, keepdims=True)), 1)
    out = np.empty(len(f), np.int64)
    for i in range(0, len(f), 4096):
        out[i : i + 4096] = (f[i : i + 4096] @ unit.T).argmax(1)
    return out


def class_shares(classes: np.ndarray, often: np.ndarray) -> np.ndarray:
    """log10 of the part that each word of the vocabulary has of its class."""
    return np.log10(often / np.maximum(np.bincount(classes, often), 1)[classes])


def pair_counts(docs: DataFrame, learning: Column, known: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Counts of (previous class, class) over all training tokens; a text begins after its end."""
    many = int(classes.max(initial=0)) + 1
    shared = docs.sparkSession.sparkContext.broadcast((known, classes))

    def rows(batches):
        total = np.zeros(many * many, np.int64)
        for b in pieces(batches):
            now, before, _ = class_of(*tokens(b), *shared.value)
            at, times = np.unique(before * many + now, return_counts=True)
            total[at] += times
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    found = docs.where(learning).select("text").mapInArrow(rows, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(many * many, np.int64)
    out[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(many, many)


def steps(pairs: np.ndarray) -> int:
    """Steps of training: as many draws as there are pairs of classes that occur, STEPS at least."""
    return max(STEPS, -(-np.count_nonzero(pairs) // PAIRS))


def train(pairs: np.ndarray) -> dict[str, np.ndarray]:
    """Vectors of classes before and after, the matrix between them and biases, by noise-contrastive
    estimation: pairs drawn from the counts against classes drawn from their frequencies."""
    rng = np.random.Generator(np.random.PCG64(7))
    n = len(pairs)
    weight = pairs.ravel().cumsum().astype(float)
    noise = (pairs.sum(0) + 1.0) / (pairs.sum() + n)
    model = {"before": rng.normal(0, 0.1, (n, WIDTH)), "after": rng.normal(0, 0.1, (n, WIDTH)), "between": np.eye(WIDTH), "bias": np.log(noise)}
    if not weight[-1]:
        return model
    heat = {k: np.full_like(v, 1e-6) for k, v in model.items()}
    cumulative = noise.cumsum()
    for _ in range(steps(pairs)):
        at = np.searchsorted(weight, rng.random(PAIRS) * weight[-1], "right")
        prior, real = at // n, at % n
        fake = np.minimum(np.searchsorted(cumulative, rng.random((PAIRS, NOISE))), n - 1)
        target = np.concatenate([real[:, None], fake], 1)
        context = model["before"][prior] @ model["between"]
        vectors = model["after"][target]
        logit = np.einsum("pd,pkd->pk", context, vectors) + model["bias"][target] - np.log(NOISE * noise[target])
        error = -1 / (1 + np.exp(-logit))
        error[:, 0] += 1
        error /= PAIRS
        pull = np.einsum("pk,pkd->pd", error, vectors)
        place = np.arange(PAIRS)
        to = np.bincount((place[:, None] * n + target).ravel(), error.ravel(), PAIRS * n).reshape(PAIRS, n)
        of = np.bincount(place * n + prior, minlength=PAIRS * n).reshape(PAIRS, n).astype(float)
        grads = {"before": of.T @ (pull @ model["between"].T), "after": to.T @ context, "between": model["before"][prior].T @ pull, "bias": to.sum(0)}
        for k, g in grads.items():
            heat[k] += g * g
            model[k] += RATE * g / np.sqrt(heat[k])
    return model


def log_probabilities(model: dict[str, np.ndarray]) -> np.ndarray:
    """Normalised log10 probability of each class (column) after each class (row)."""
    logit = model["before"] @ model["between"] @ model["after"].T + model["bias"]
    logit -= logit.max(1, keepdims=True)
    return (logit - np.log(np.exp(logit).sum(1, keepdims=True))) / np.log(10)


def rare_shares(kinds: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """log10 probability, inside the shared class, of one word of each class of counts: with one
    occurrence held back, a word counted r times stands for one counted r - 1 times."""
    weight = np.zeros(COUNTS)
    weight[0] = mass[1] + 1.0  # once: unknown but for that occurrence
    for r in range(1, COUNTS):
        after = mass[r + 1] if r + 1 < COUNTS else mass[r]
        weight[r] = (after if r < 3 else mass[r]) + 0.5 if kinds[r] else 0.0
    kinds = np.concatenate([[1.0], kinds[1:]])
    return np.log10(np.maximum(weight, 1e-300) / weight.sum() / np.maximum(kinds, 1))


def rare_word(c: np.ndarray, kinds: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """log10 probability, inside the shared class, of words counted c times."""
    r = count_class(c)
    return rare_shares(kinds, mass)[r] + np.where(c > 0, np.log10(np.maximum(c, 1) * np.maximum(kinds, 1)[r] / np.maximum(mass, 1)[r]), 0.0)


def score(docs: DataFrame, learning: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score for each row of docs (doc_id,
    text); rows for which `learning` holds are counted and train the model."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    counted = count_words(docs, learning)
    n, v, known, (kinds, mass), frequent = summary(counted, least_count(counted))
    classes = word_classes(docs, learning, n, known, frequent)
    model = train(pair_counts(docs, learning, known, classes))
    shared = spark.sparkContext.broadcast((known, frequent, classes, model, (kinds, mass)))
    base = float(np.log10(n + v + 1))
    many, parts = buckets(spark, text_bytes(docs) // 16)

    def emit(batches):
        """A row for each document with the sums over the vocabulary, and its rare words by bucket."""
        words_, often, classes, model, _ = shared.value
        table = log_probabilities(model)
        done = TaskContext.get().partitionId() << 33  # numbers of rows, as ids may be null or repeated
        share, often = np.append(class_shares(classes, often), 0.0), np.log10(np.append(often, 0) + 1.0)
        for b in pieces(batches):
            h, first = tokens(b)
            now, before, at = class_of(h, first, words_, classes)
            sums = [np.concatenate([[0.0], np.cumsum(x)]) for x in (table[before, now] + share[at], often[at], (at >= 0).astype(float))]
            key = b.column("doc_id")
            rows = [s[first[1:]] - s[first[:-1]] for s in sums]
            size = np.diff(first)
            ids = done + np.arange(b.num_rows)
            done += b.num_rows
            yield pa.RecordBatch.from_arrays([key, pa.array(ids), pa.array(rows[0]), pa.array(rows[1] - size * base), pa.array(rows[2].astype(np.int64)), pa.array(size), pa.nulls(b.num_rows, pa.int32()), *(pa.nulls(b.num_rows, pa.binary()) for _ in range(3))], names=["doc_id", "row", "s", "b", "known", "n", "bucket", "k", "d", "t"])
            rare = at < 0
            row = np.repeat(np.arange(len(size)), size)[rare]
            if len(row):
                k, at, times = np.unique(np.stack([h[rare].view(np.int64), row], 1).view([("k", "i8"), ("d", "i8")]).ravel(), return_index=True, return_counts=True)
                k = h[rare][at]
                sent = routed(k, [k, ids[row[at]], times.astype(np.int32)], many, ["k", "d", "t"])
                none = sent.num_rows
                yield pa.RecordBatch.from_arrays([*(pa.nulls(none, pa.int64()) for _ in range(2)), *(pa.nulls(none, pa.float64()) for _ in range(2)), *(pa.nulls(none, pa.int64()) for _ in range(2)), *sent.columns], names=["doc_id", "row", "s", "b", "known", "n", "bucket", "k", "d", "t"])

    sent = stored(docs.mapInArrow(emit, "doc_id long, row long, s double, b double, known long, n long, bucket int, k binary, d binary, t binary"))
    own = sent.where("bucket is null").select("doc_id", "row", "s", "b", "known", "n")
    # counts of all words stand beside the rare words of their bucket
    table = counted.select("k", "c").mapInArrow(lambda batches: again(batches, many), "bucket int, k binary, c binary")
    rare = sent.where("bucket is not null").select("bucket", "k", "d", "t", F.lit(None).cast("binary").alias("c"))
    both = rare.unionAll(table.select("bucket", "k", F.lit(None).cast("binary").alias("d"), F.lit(None).cast("binary").alias("t"), "c"))

    def meet(batches):
        kinds, mass = shared.value[4]
        held: dict[str, list[np.ndarray]] = {x: [] for x in ("k", "d", "t", "wk", "wc")}
        for b in batches:
            for k, d, t, c in zip(*(b.column(x).to_pylist() for x in ("k", "d", "t", "c")), strict=True):
                if c is None:
                    held["k"].append(np.frombuffer(k, np.uint64))
                    held["d"].append(np.frombuffer(d, np.int64))
                    held["t"].append(np.frombuffer(t, np.int32))
                else:
                    held["wk"].append(np.frombuffer(k, np.uint64))
                    held["wc"].append(np.frombuffer(c, np.int64))
        if not held["k"]:
            return
        k, d, t = (np.concatenate(held[x]) for x in ("k", "d", "t"))
        wk = np.concatenate([np.zeros(0, np.uint64), *held["wk"]])
        wc = np.concatenate([np.zeros(0, np.int64), *held["wc"]])
        order = np.argsort(wk)
        wk, wc = wk[order], wc[order]
        c = np.zeros(len(k), np.int64)
        if len(wk):
            at = np.minimum(np.searchsorted(wk, k), len(wk) - 1)
            c = np.where(wk[at] == k, wc[at], 0)
        docs_, which = np.unique(d, return_inverse=True)
        sums = [np.bincount(which, x * t, len(docs_)) for x in (rare_word(c, kinds, mass), np.log10(c + 1.0), (c > 0).astype(float))]
        yield pa.RecordBatch.from_arrays([pa.array(docs_), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2].astype(np.int64))], names=["row", "s", "b", "known"])

    back = both.repartition(parts, "bucket").select("k", "d", "t", "c").mapInArrow(meet, "row long, s double, b double, known long")
    back = back.groupBy("row").agg(F.sum("s").alias("rs"), F.sum("b").alias("rb"), F.sum("known").alias("rk"))
    out = own.join(back, "row", "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("rk", F.lit(0))).alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("b") + F.coalesce("rb", F.lit(0.0))).alias("base_score"),
        (F.col("s") + F.coalesce("rs", F.lit(0.0))).alias("score"),
    )


def again(batches, many: int):
    for b in batches:
        for k, c in zip(b.column("k").to_pylist(), b.column("c").to_pylist(), strict=True):
            k, c = np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64)
            if len(k):
                yield routed(k, [k, c], many, ["k", "c"])


def op2_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return score(docs, ~held_out).withColumn("held_out", held_out).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")

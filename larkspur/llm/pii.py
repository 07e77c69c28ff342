"""Personal data by weak supervision, in DataFrame and SQL functions alone.

Patterns propose spans: the strict ones of the base, and looser ones (e-mail addresses written with
[at], national phone numbers, cards of 13 to 15 digits, long IP addresses). Five labelers vote on
each span: the strict pattern, a checksum or shape, a gazetteer (top-level domains, issuers, calling
codes, address ranges), words of context before the span, and its borders. The votes of all
documents are counted by pattern (at most 4 kinds x 32 patterns); expectation-maximisation over
these counts estimates how reliable each labeler is, and its posteriors train a logistic classifier
of spans, which is then a plain SQL expression. Base spans always stay; a looser span is added if
the classifier gives it 0.5 or more and no base span overlaps it.

Cases: a null text counts as empty and has no spans; equal rows are treated alike; very long runs of
one character class are read once (patterns are possessive and start at the run's beginning); what
stands around a match is taken from the text between matches, so a long text is not read anew for each
of them; rows that repeat, and rows with null or repeated ids, stand each for itself; an empty table
gives no rows; other columns stay, but for pii, which is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that each run is read once, with the same matches.
BASE = {
    "email": r"(?=[A-Za-z0-9._%+-])(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(]dot[\])]|\.) ?[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "phone": r"(?<![0-9A-Za-z+.(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
}
#: What a text must hold for a pattern to be tried at all.
NEEDS = {"email": ["@"], "phone": ["+"]}
NEEDS_LOOSE = {"email": ["[at]", "(at)"], "ip": [":"]}
CONTEXT = {"email": "mail|contact|write|reach", "ip": "ip|address|host|server", "card": "card|visa|credit|payment|account", "phone": "phone|tel|call|mobile|fax|whatsapp"}
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$",
    "ip": r"^(?!0|127\.|255\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^(?:\+(?:1|2[07]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-8])|\(?[2-9])",
}
LABELERS, ROUNDS = 5, 30
SPAN = "struct<kind: string, s: int, e: int, base: boolean, votes: int>"


def quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def luhn(d: str) -> str:
    """Whether a string of digits passes Luhn's check."""
    digit = f"cast(substring({d}, length({d}) - i + 1, 1) as int)"
    return f"aggregate(sequence(1, length({d})), 0, (a, i) -> a + if(i % 2 = 1, {digit}, 2 * {digit} - if({digit} > 4, 9, 0))) % 10 = 0"


def valid(kind: str, x: str) -> str:
    """Whether a match of the strict pattern is a base span."""
    if kind == "ip":
        return f"forall(split({x}, '[.]'), p -> length(ltrim('0', p)) <= 3 and coalesce(try_cast('0' || right(ltrim('0', p), 9) as int), 999) <= 255)"
    if kind == "card":
        return f"length({digits(x)}) between 16 and 19 and {luhn(digits(x))}"
    if kind == "phone":
        return f"length({digits(x)}) between 8 and 15"
    return "true"


def shape(kind: str, x: str) -> str:
    """The labeler of checksums and shapes."""
    return {"email": f"length({x}) <= 254 and not {x} rlike '[.][.]|^[.]|[.]@'", "ip": f"not {x} rlike '(^|[.:])0[0-9]'", "card": luhn(digits(x)), "phone": f"length({digits(x)}) between 10 and 13"}[kind]


def matches(pattern: str, needs: list[str]) -> str:
    """SQL for all matches of a pattern in column text; no search where the text lacks what it needs."""
    found = f"regexp_extract_all(text, {quoted(pattern)}, 0)"
    return f"if({' or '.join(f"contains(text, '{n}')" for n in needs)}, {found}, array())" if needs else found


def spans(kind: str, keep: str, base: bool, hits: str, gaps: str) -> str:
    """SQL for the array of a pattern's spans in column text: the matches (column hits) and the pieces
    between them (column gaps) give each match's place, what stands before it and the character after."""
    vote = " + ".join(
        f"{1 << k} * cast(({v}) as int)"
        for k, v in enumerate(
            [
                "true" if base else "false",
                shape(kind, "z.hit"),
                f"{digits('z.hit') if kind == 'card' else 'z.hit'} rlike {quoted(GAZETTEER[kind])}",
                f"lower(right(a.tail || z.gap, 31)) rlike '{CONTEXT[kind]}'",
                "not z.next rlike '[A-Za-z0-9]' and not right(z.gap, 1) rlike '[A-Za-z0-9]'",
            ]
        )
    )
    end = "a.at + length(z.gap) + length(z.hit)"
    span = f"named_struct('kind', '{kind}', 's', a.at + length(z.gap), 'e', {end}, 'base', {str(base).lower()}, 'votes', {vote})"
    after = f"zip_with(slice({gaps}, 2, size({hits})), slice({hits}, 2, size({hits})), (g, h) -> if(g = '', coalesce(left(h, 1), ''), left(g, 1)))"
    return f"""if(size({hits}) = 0, cast(array() as array<{SPAN}>), aggregate(
        zip_with(zip_with(slice({gaps}, 1, size({hits})), {hits}, (g, h) -> named_struct('gap', g, 'hit', h)), {after}, (z, x) -> named_struct('gap', z.gap, 'hit', z.hit, 'next', x)),
        named_struct('at', 0, 'tail', '', 'out', cast(array() as array<{SPAN}>)),
        (a, z) -> named_struct('at', {end}, 'tail', right(a.tail || right(z.gap, 31) || z.hit, 31), 'out', if({keep}, array_append(a.out, {span}), a.out)),
        a -> a.out))"""


def candidates(docs: DataFrame) -> DataFrame:
    """docs with an array of all spans that any pattern proposes; text is never null."""
    df = docs.withColumn("text", F.coalesce("text", F.lit("")))
    plans = [(k, BASE[k], valid(k, "z.hit"), True, NEEDS.get(k, [])) for k in KINDS]
    plans += [("card", BASE["card"], f"length({digits('z.hit')}) between 13 and 15 and {luhn(digits('z.hit'))}", False, [])]
    plans += [(k, LOOSE[k], "true", False, NEEDS_LOOSE.get(k, [])) for k in LOOSE]
    columns = {p: f"__hits{i}" for i, p in enumerate(dict.fromkeys(p for _, p, *_ in plans))}
    df = df.withColumns({columns[p]: F.expr(matches(p, needs)) for _, p, _, _, needs in plans})
    df = df.withColumns({f"{c}_gaps": F.expr(f"if(size({c}) = 0, cast(array() as array<string>), split(text, {quoted(p)}, -1))") for p, c in columns.items()})
    parts = {f"__spans{i}": F.expr(spans(k, keep, base, columns[p], f"{columns[p]}_gaps")) for i, (k, p, keep, base, _) in enumerate(plans)}
    df = df.withColumns(parts)
    return df.select(*docs.columns, F.concat(*parts).alias("__spans"))


def learn(counts: dict[tuple[str, int], int]) -> dict[str, list[float]]:
    """Weights (a bias, then one for each labeler) of each kind's classifier, from counts of votes."""
    out = {}
    for kind in KINDS:
        cells = [([v >> k & 1 for k in range(LABELERS)], n) for (own, v), n in sorted(counts.items()) if own == kind]
        prior, hit, miss = 0.7, [0.8] * LABELERS, [0.3] * LABELERS
        post = []
        for _ in range(ROUNDS):
            post = []
            for votes, _n in cells:
                yes = prior * math.prod(h if v else 1 - h for v, h in zip(votes, hit, strict=True))
                no = (1 - prior) * math.prod(m if v else 1 - m for v, m in zip(votes, miss, strict=True))
                post.append(yes / (yes + no))
            good = sum(p * n for p, (_, n) in zip(post, cells, strict=True))
            bad = sum((1 - p) * n for p, (_, n) in zip(post, cells, strict=True))
            prior = min(0.95, max(0.05, (good + 7) / (good + bad + 10)))
            for k in range(LABELERS):
                hit[k] = (sum(p * n for p, (v, n) in zip(post, cells, strict=True) if v[k]) + 8) / (good + 10)
                miss[k] = (sum((1 - p) * n for p, (v, n) in zip(post, cells, strict=True) if v[k]) + 3) / (bad + 10)
        weights = [0.0] * (LABELERS + 1)
        total = sum(n for _, n in cells) or 1
        for _ in range(500):  # logistic regression on the posteriors
            slope = [0.01 * w for w in weights]
            for p, (votes, n) in zip(post, cells, strict=True):
                x = [1, *votes]
                error = 1 / (1 + math.exp(-sum(a * b for a, b in zip(weights, x, strict=True)))) - p
                slope = [s + error * a * n / total for s, a in zip(slope, x, strict=True)]
            weights = [w - 0.5 * s for w, s in zip(weights, slope, strict=True)]
        out[kind] = weights
    return out


def find(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with pii: all spans (kind, s, e, base) by kind, then start. Places
    count code points; e is exclusive."""
    keep = keep or docs.columns
    found = stored(candidates(docs).select(*keep, "__spans"))
    counted = found.select(F.explode("__spans").alias("x")).groupBy("x.kind", "x.votes").count().collect()
    weights = learn({(r["kind"], r["votes"]): r["count"] for r in counted})

    def likely(x: Column) -> Column:
        case = F.lit(False)
        for kind, (bias, *own) in weights.items():
            total = F.lit(bias)
            for k, w in enumerate(own):
                total = total + F.lit(w) * x["votes"].bitwiseAND(F.lit(1 << k)).cast("boolean").cast("int")
            case = F.when(x["kind"] == kind, total >= 0).otherwise(case)
        return case

    sure = F.filter("__spans", lambda x: x["base"])
    added = F.filter("__spans", lambda x: ~x["base"] & likely(x) & ~F.exists(sure, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    place = F.create_map(*[F.lit(v) for i, k in enumerate(KINDS) for v in (k, i)])
    ordered = F.array_sort(F.transform(F.concat(sure, added), lambda x: F.struct(F.element_at(place, x["kind"]).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), x["base"].alias("base"))))
    return found.select(*keep, ordered.alias("pii"))


def digest(array: Column) -> Column:
    return F.array_join(F.transform(array, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def mask(found: DataFrame) -> DataFrame:
    """Each span of pii in text replaced by its kind in brackets; overlapping spans become one. A
    text without spans stays as it is, null included."""
    by_place = "array_sort(transform(pii, x -> named_struct('s', x.s, 'e', x.e, 'kind', x.kind)))"
    text = f"""if(coalesce(size(pii), 0) <= 0, text, aggregate({by_place}, named_struct('at', 0, 'out', ''),
        (a, x) -> if(x.s >= a.at,
            named_struct('at', x.e, 'out', a.out || substring(text, a.at + 1, x.s - a.at) || '[' || upper(x.kind) || ']'),
            named_struct('at', greatest(a.at, x.e), 'out', a.out)),
        a -> a.out || substring(text, a.at + 1)))"""
    return found.withColumn("text", F.expr(text))


def op7_pii(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ["doc_id"])
    base = F.filter("pii", lambda x: x["base"])
    of_kind = lambda k: F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [of_kind(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("pii")).alias("spans"))

"""Category-blocked fuzzy candidates.

Texts of offers meet texts of the catalogue in their category, which is cut into slices by the
catalogue's texts, as there are few categories. They are scored once for each distinct pair (offers
repeat a few texts in many pack sizes). Of catalogue rows of one category, text and pack sizes only the
first k + 1 can be among an offer's k + 1 best; of those, each distinct pack size of offers keeps the
first k + 1 of a text whose packs fit, don't, or may. Offers then meet these by category, text and size,
so that no offer meets its whole category. Rows are ranked apart for packs that may fit and packs that
don't, so that `row_number() <= k + 1` drops rows before the shuffle (WindowGroupLimit), whatever packs
an offer turns out to have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import measures as m
from ..functions.similarity import word_similarity
from ..sources.scratch import slices, stored
from .validate import require_columns

OFFER_COLUMNS = ["match_text", "offer_measures", "offer_measures_detailed", "category"]
MASTER_COLUMNS = ["Itemcode", "Itemname", "match_text", "master_measures", "master_measures_detailed", "category", "master_ord"]
NONE = "NO_MATCH"


def short(text: Column) -> Column:
    """Fewer than two words: too little to match."""
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")) < 2


def adjusted(score: Column, fits: Column, bonus: float, unknown: float) -> Column:
    return score + F.when(fits, bonus).when(fits.isNull(), unknown).otherwise(0.0)


def candidates(offers: DataFrame, master: DataFrame, k: int = 5, bonus: float = 4.0, unknown: float = -3.0) -> DataFrame:
    """The k best catalogue rows of each offer (offer_ord), or one row that says why there is none.

    Packs that are known not to fit are left out unless no pack fits. Ties go to catalogue order.
    An offer of category Other without such catalogue rows searches the whole catalogue. Margins
    are the lead over the next rank, 100 after the last; scores aren't rounded here."""
    if k < 1:
        raise ValueError("k must be at least 1")
    require_columns(offers, [*OFFER_COLUMNS, "offer_ord"], "offers")
    require_columns(master, MASTER_COLUMNS, "master")
    left = offers.select("offer_ord", "category", F.col("match_text").alias("offer_text"), "offer_measures", "offer_measures_detailed")
    left = left.withColumn("too_short", short(F.col("offer_text")))
    left = left if hasattr(offers, "_larkspur_path") else stored(left)
    right = master.where("category is not null").select(F.col("category").alias("pool"), "Itemcode", "Itemname", F.col("match_text").alias("master_match_text"), "master_measures", "master_measures_detailed", "master_ord")
    right = stored(firsts(right, ["pool", "master_match_text", "master_measures"], k + 1))
    pools = right.select("pool").distinct()
    whole = right.join(pools.where("pool = 'Other'").limit(1).select(F.lit(1).alias("__has")), F.lit(True), "left_anti").withColumn("pool", F.lit("Other"))
    right = right.unionAll(whole)
    asked = left.where("not too_short")
    scored = text_scores(asked.select("category", "offer_text"), right.select(F.col("pool").alias("category"), "master_match_text"), ["category"])
    near = asked.join(scored, ["category", "offer_text"])
    fitted = fits(asked.select("category", "offer_measures"), right.withColumnRenamed("pool", "category"), k + 1)
    pairs = near.join(fitted, (near["category"] == fitted["__category"]) & (near["master_match_text"] == fitted["__text"]) & near["offer_measures"].eqNullSafe(fitted["__sizes"])).drop("__category", "__text", "__sizes")
    pairs = pairs.withColumns({"adjusted_score": adjusted(F.col("score"), F.col("pack_status"), bonus, unknown), "may_fit": F.coalesce("pack_status", F.lit(True))})
    order = [F.desc("adjusted_score"), "master_ord"]
    pairs = pairs.withColumn("__n", F.row_number().over(Window.partitionBy("offer_ord", "may_fit").orderBy(*order))).where(F.col("__n") <= k + 1).drop("__n")
    mine = Window.partitionBy("offer_ord")
    pairs = pairs.withColumn("all_candidates_incompatible", ~F.max("may_fit").over(mine)).where("may_fit or all_candidates_incompatible")
    best = mine.orderBy(*order)
    ranked = pairs.withColumn("candidate_rank", F.row_number().over(best))
    ranked = ranked.withColumns({"margin": F.coalesce(F.col("adjusted_score") - F.lead("adjusted_score").over(best), F.lit(100.0)), "raw_margin": F.coalesce(F.col("score") - F.lead("score").over(best), F.lit(100.0))})
    found = ranked.where(F.col("candidate_rank") <= k).select(
        "offer_ord", F.col("Itemcode").alias("itemcode"), F.col("Itemname").alias("itemname"), F.col("score").alias("text_score"), "adjusted_score", "margin", "raw_margin", "pack_status",
        m.pack_structure(F.col("offer_measures_detailed"), F.col("master_measures_detailed")).alias("pack_structure_status"),
        "category", "candidate_rank", "all_candidates_incompatible", F.lit(None).cast("string").alias("confidence_tier"), "master_match_text", "master_measures",
    )
    open_ = right.select(F.col("pool").alias("category")).distinct()
    lone = left.where("too_short").select("offer_ord", "category", F.lit("no_match_empty_text").alias("tier"))
    lone = lone.join(open_, "category", "left_semi").select("offer_ord", "category", "tier").unionAll(left.join(open_, "category", "left_anti").select("offer_ord", "category", F.lit("no_match_category")))
    zero, no = F.lit(0.0), F.lit(None).cast("boolean")
    none = lone.select("offer_ord", F.lit(NONE), F.lit("None"), zero, zero, zero, zero, no, no, "category", F.lit(0), F.lit(False), "tier", F.lit(""), F.array().cast("array<struct<v: double, d: string>>"))
    return found.unionAll(none)


def firsts(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first n rows of each key in catalogue order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("master_ord"))).where(F.col("__n") <= n).drop("__n")


def fits(sizes: DataFrame, master: DataFrame, n: int) -> DataFrame:
    """For the distinct pack sizes of offers (category, offer_measures): the first n catalogue rows of each
    text whose packs fit, and of those that don't or may. Offers of one text and one size rank these
    alike, so rows are met by sizes and not by each offer. Catalogue rows are dealt into slices."""
    count = slices(sizes.sparkSession)
    left = sizes.distinct().select(F.col("category").alias("__category"), F.col("offer_measures").alias("__sizes"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("__slice"))
    right = master.withColumn("__in", F.pmod(F.xxhash64("master_match_text"), F.lit(count)).cast("int")).withColumnsRenamed({"category": "__of", "master_match_text": "__text"})
    met = left.join(right, (left["__category"] == right["__of"]) & (left["__slice"] == right["__in"])).drop("__of", "__in", "__slice")
    met = met.withColumn("pack_status", m.pack_compatible(F.col("__sizes"), F.col("master_measures")))
    return firsts(met, ["__category", "__sizes", "__text", "pack_status"], n)


def text_scores(offers: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct texts of two tables (keys and one text column each) that share the keys, with their
    word similarity as score, computed once for each distinct pair. The right side's texts are dealt
    into slices, and the left side's go to all of them: a key of most rows is worked on by all tasks."""
    (a,), (b,) = ([c for c in df.columns if c not in keys] for df in (offers, others))
    n = slices(offers.sparkSession)
    left = offers.distinct().withColumn("__slice", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    pairs = left.join(others.distinct().withColumn("__slice", F.pmod(F.xxhash64(b), F.lit(n)).cast("int")), [*keys, "__slice"]).drop("__slice")
    scores = pairs.select(a, b).distinct().withColumn("score", word_similarity(F.col(a), F.col(b)))
    return pairs.join(scores, [a, b])


def top_candidates(offer: DataFrame, master: DataFrame, k: int = 5, **settings) -> DataFrame:
    """The ranked candidates of a single prepared offer."""
    return candidates(_single(offer), master, k, **settings).orderBy("candidate_rank")


def best_candidate(offer: DataFrame, master: DataFrame, **settings) -> Row:
    """The best candidate of a single prepared offer, or the row that says why there is none."""
    return candidates(_single(offer), master, 1, **settings).first()


def _single(offer: DataFrame) -> DataFrame:
    if len(offer.limit(2).collect()) != 1:
        raise ValueError("exactly one offer is asked for")
    return offer if "offer_ord" in offer.columns else offer.withColumn("offer_ord", F.lit(0).cast("long"))


def unique_keys(offers: DataFrame) -> DataFrame:
    """One row for each distinct matching key of offers: the first by offer_ord. Stored, as few keys come
    from many offers."""
    first = Window.partitionBy("match_text", "offer_measures", "category").orderBy("offer_ord")
    return stored(offers.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n"))

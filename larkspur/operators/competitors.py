"""Competing offers of other brands for accepted items, by country and product family. Texts are
scored first, so that offers meet by country, family and a text that reaches the floor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures as m
from ..functions import text as t
from ..sources.scratch import few, numbered, stored
from .candidates import adjusted, text_scores

LONG = [
    "Country", "Product", "Own Itemcode", "Own Itemname", "Own Pack", "Own Retail Unit", "Competitor Brand", "Competitor Offer",
    "Competitor Pack", "Competitor Retail Unit", "Raw Score", "Adjusted Score", "Pack Status", "Competitor Type", "Rank",
]
DIRECT, UNVERIFIED = "Direct competitor", "Pack unverified"
KEY = ["Country", "product_family", "matched_itemcode", "offer_measures"]
#: Keys with their summaries, about 400 bytes each, that may be sent to all executors: offers then stay where they are.
SUMMARIES_SENT = 100_000


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n")


def find_competitors(mapped: DataFrame, raw_floor: float = 60.0, adjusted_floor: float = 65.0, bonus: float = 3.0, unknown: float = -3.0, most: int = 5) -> DataFrame:
    """For each accepted (country, family, item, pack) the best offer of each other brand, `most` at
    most, with its rank. Packs that are known not to fit are out; rows without country or family form
    no group. Ties go to the earlier offer."""
    grouped = mapped.where("Country is not null and product_family is not null")
    targets = first_by(grouped.where("is_own and confidence_tier = 'high (ml)'"), KEY, "offer_ord").select(*KEY, "Product", "matched_itemname", "master_match_text", "offer_measures_detailed", "Base Packsize", F.col("offer_ord").alias("target_ord"))
    targets = numbered(targets, "__t")
    pool = first_by(grouped.where("not is_own"), ["Country", "product_family", "Brand Name", "clean_offer_text", "offer_measures"], "offer_ord")
    pool = pool.select("Country", "product_family", F.col("Brand Name").alias("brand"), F.col("Offer Name").alias("offer"), F.col("Base Packsize").alias("pack"), F.col("match_text").alias("text"), F.col("offer_measures").alias("sizes"), F.col("offer_measures_detailed").alias("details"), F.col("offer_ord").alias("pool_ord"))
    pool = numbered(pool, "__p")
    near = text_scores(targets.select("Country", "product_family", "master_match_text"), pool.select("Country", "product_family", "text"), ["Country", "product_family"])
    near = near.withColumnRenamed("score", "raw").where((F.col("raw") >= raw_floor) & (F.col("raw") + max(bonus, unknown) >= adjusted_floor))
    wanted = targets.select("__t", "Country", "product_family", "master_match_text", "offer_measures", "target_ord")
    offered = pool.select("__p", "Country", "product_family", "text", "sizes", "brand", "pool_ord")
    pairs = wanted.join(near, ["Country", "product_family", "master_match_text"]).join(offered, ["Country", "product_family", "text"])
    pairs = pairs.withColumn("fits", m.pack_compatible(F.col("offer_measures"), F.col("sizes"))).where("fits is null or fits")
    pairs = pairs.withColumn("score", adjusted(F.col("raw"), F.col("fits"), bonus, unknown)).where(F.col("score") >= adjusted_floor)
    pairs = pairs.select("__t", "__p", "target_ord", "brand", "pool_ord", "raw", "fits", "score")
    order = [F.desc("score"), "pool_ord"]
    best = pairs.withColumn("__n", F.row_number().over(Window.partitionBy("target_ord", "brand").orderBy(*order))).where("__n = 1")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("target_ord").orderBy(*order))).where(F.col("rank") <= most)
    best = best.select("__t", "__p", "raw", "fits", "score", "rank")
    return best.join(targets, "__t").join(pool.drop("Country", "product_family"), "__p").drop("__t", "__p")


def long_table(found: DataFrame) -> DataFrame:
    """The long table, by item and rank; rows of equal rank stay in the order of their first offer."""
    return found.orderBy("matched_itemcode", "rank", "target_ord").select(
        "Country", "Product", F.col("matched_itemcode").alias("Own Itemcode"), F.col("matched_itemname").alias("Own Itemname"), F.col("Base Packsize").alias("Own Pack"),
        t.retail_unit(F.col("offer_measures_detailed")).alias("Own Retail Unit"), F.col("brand").alias("Competitor Brand"), F.col("offer").alias("Competitor Offer"),
        F.col("pack").alias("Competitor Pack"), t.retail_unit(F.col("details")).alias("Competitor Retail Unit"), F.bround("raw", 1).alias("Raw Score"),
        F.bround("score", 1).alias("Adjusted Score"), F.col("fits").alias("Pack Status"), F.when(F.col("fits"), DIRECT).otherwise(UNVERIFIED).alias("Competitor Type"), F.col("rank").alias("Rank"),
    )


def with_summary(mapped: DataFrame, found: DataFrame, firsts: DataFrame | None = None) -> DataFrame:
    """mapped with competitor_matches: `brand: offer [score]`, joined by `; ` in order of rank. firsts: rows
    that have all keys of mapped, where it has many more."""
    one = F.concat(F.col("brand"), F.lit(": "), F.col("offer"), F.lit(" ["), F.bround("raw", 0).cast("bigint").cast("string"), F.lit("]"), F.when(F.col("fits"), "").otherwise(" (pack unverified)"))
    summary = found.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", one.alias("x")))), lambda r: r["x"]), "; ").alias("summary"))
    key = [f"__{k}" for k in KEY]
    named = lambda df, *more: df.select(*(F.col(k).alias(n) for k, n in zip(KEY, key, strict=True)), *more)
    targets = named((mapped if firsts is None else firsts).where("is_own and confidence_tier = 'high (ml)' and Country is not null and product_family is not null")).distinct()
    known = stored(targets.join(named(summary, "summary"), key, "left").select(*key, F.coalesce("summary", F.lit("None Found")).alias("__found")))
    known = F.broadcast(known) if few(known, SUMMARIES_SENT) else known
    joined = mapped.join(known, F.expr(" and ".join(f"`{k}` <=> `{n}`" for k, n in zip(KEY, key, strict=True))), "left")
    text = F.coalesce("__found", F.lit("Not computed (row not auto-accepted, or is a competitor-brand row)"))
    return joined.withColumn("competitor_matches", text).drop(*key, "__found")

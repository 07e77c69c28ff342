"""The final tables: one row for each catalogue row, in catalogue order, with numbered cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.scratch import stored

# Names and order of the columns of the final tables.
OFFER_EXPORT = ["Master SKU", "Confirmed Matched Offers", "Medium Confidence Offers", "Low Confidence Offers"]
MAPPING = [
    "Country", "Retailer Name", "Flyer Name", "Analysis week", "offerid", "Offer Name", "Brand Name", "segment", "Product", "Variant",
    "Base Packsize", "Offer Price", "Regular Price", "Discount_percent", "matched_itemcode", "matched_itemname", "suggested_itemcode",
    "suggested_itemname", "match_score", "margin", "raw_margin", "pack_status", "confidence_tier", "ml_probability", "ml_decision", "competitor_matches",
]


def numbered(text: Column, order: list[Column]) -> Column:
    """`1. a | 2. b`: non-blank texts of a group in order, each on one line."""
    line = t.single_spaced(t.safe(text))
    rows = F.array_sort(F.collect_list(F.when(line != "", F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), line.alias("x")))))
    return F.array_join(F.transform(rows, lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r["x"])), " | ")


def mapping(df: DataFrame) -> DataFrame:
    """The detailed mapping; columns that the input lacks come as null."""
    return df.select(*((F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string")).alias(c) for c in MAPPING))


def _on_master(master: DataFrame, label: str, cells: DataFrame) -> DataFrame:
    """A row for each catalogue row, in its order, with the cells of its code; empty where there are none."""
    names = [c for c in cells.columns if c != "Itemcode"]
    out = master.select("master_ord", "Itemcode", t.sku_label(F.col("Itemcode"), F.col("Itemname")).alias(label)).join(cells, "Itemcode", "left")
    return out.orderBy("master_ord").select(label, *(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names))


def offer_export(master: DataFrame, mapped: DataFrame, currency: str = "SAR") -> DataFrame:
    """Confirmed offers by matched item, medium and low ones by suggested item: one aggregate for all
    three cells."""
    tiers = dict(zip(["high (ml)", "medium (ml)", "low (ml)"], OFFER_EXPORT[1:], strict=True))
    tier = F.col("confidence_tier")
    shown = mapped.where(tier.isin(*tiers)).withColumn("__x", t.offer_display(F.col("Offer Name"), F.col("Retailer Name"), F.col("Offer Price"), currency))
    key = F.when(tier == "high (ml)", F.col("matched_itemcode")).otherwise(F.col("suggested_itemcode"))
    cells = shown.groupBy(key.alias("Itemcode")).agg(*(numbered(F.when(tier == k, F.col("__x")), [F.col("offer_ord")]).alias(name) for k, name in tiers.items()))
    return _on_master(master, OFFER_EXPORT[0], cells)


def competitor_export(master: DataFrame, found: DataFrame, label: str = "Own Master SKU") -> DataFrame:
    order = [F.col("rank"), F.col("target_ord")]
    offers = F.concat(F.col("offer"), F.lit(" ("), F.col("pack"), F.lit(")"))
    cells = found.groupBy(F.col("matched_itemcode").alias("Itemcode")).agg(numbered(F.col("brand"), order).alias("Competitor Brand Names"), numbered(offers, order).alias("Competitor Offers"))
    return _on_master(master, label, cells)


def in_order(df: DataFrame) -> DataFrame:
    """The rows with their place (at) in the order in which they come: places in each partition, after
    the rows of the partitions before, of which only the counts come together."""
    df = stored(df.withColumn("__id", F.monotonically_increasing_id()))
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    counts = df.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.join(counts.select("__part", before.alias("__before")), part == F.col("__part")).withColumn("at", F.col("__before") + place).drop("__id", "__part", "__before")


def validate_offer_export(export: DataFrame, master: DataFrame) -> None:
    """Exact columns, catalogue labels in order, and no line break in any cell."""
    if export.columns != OFFER_EXPORT:
        raise ValueError(f"unexpected export columns: {export.columns}")
    label = lambda c: c.alias("label")
    want = in_order(master.orderBy("master_ord").select(label(t.sku_label(F.col("Itemcode"), F.col("Itemname")))))
    pairs = want.join(in_order(export.select(label(F.col(f"`{OFFER_EXPORT[0]}`")))).withColumnRenamed("label", "found"), "at", "full")
    if not pairs.where(~F.col("label").eqNullSafe(F.col("found"))).isEmpty():
        raise ValueError("the export's first column doesn't match catalogue order or content")
    if not export.where(F.exists(F.array(*(F.col(f"`{c}`") for c in export.columns)), lambda c: c.rlike("[\r\n]"))).isEmpty():
        raise ValueError("the export holds line breaks")

"""Offers and catalogue with their normalised columns: projections only, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import measures as m
from ..functions import text as t

OFFER_TEXT = ["Offer Name", "Product", "Brand Name", "Variant", "Base Packsize"]
MASTER_TEXT = ["Itemname", "Item-Cat-2", "Item-Cat-4", "Item Description", "Item-Spec"]


@dataclass(frozen=True)
class OwnBrand:
    """The house's own brand: aliases after normalisation, and a pattern to leave out of offer names."""

    aliases: tuple[str, ...] = ()
    pattern: str | None = None


def filled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns without nulls; columns that are missing come as empty text."""
    return df.withColumns({c: t.safe(c) if c in df.columns else F.lit("") for c in columns})


def prepare_offers(offers: DataFrame, own: OwnBrand = OwnBrand()) -> DataFrame:
    df = filled(offers, OFFER_TEXT)
    df = df.withColumns({
        "brand_normalized": t.normalized_brand(F.col("Brand Name")),
        "category": t.category(F.col("Product")),
        "product_family": t.product_family(F.col("Product")),
        "clean_offer_text": t.clean_offer(F.col("Offer Name"), own.pattern),
        "match_text": t.offer_match_text(F.col("Offer Name"), F.col("Product"), F.col("Variant"), own.pattern),
        "offer_measures_detailed": m.offer_measures(F.concat_ws(" ", "Base Packsize", "Offer Name")),
    })
    return df.withColumns({"is_own": F.col("brand_normalized").isin(*own.aliases) if own.aliases else F.lit(False), "offer_measures": m.simple(F.col("offer_measures_detailed"))})


def prepare_master(master: DataFrame) -> DataFrame:
    df = filled(master, MASTER_TEXT)
    df = df.withColumns({
        "Itemcode": t.itemcode(F.col("Itemcode")),
        "category": t.master_category(F.col("Item-Cat-2")),
        "match_text": t.master_match_text(F.col("Itemname"), F.col("Item-Cat-4"), F.col("Item Description")),
        "master_measures_detailed": m.master_measures(F.col("Item-Spec")),
    })
    return df.withColumn("master_measures", m.simple(F.col("master_measures_detailed")))

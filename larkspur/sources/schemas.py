"""Declared schemas: identifiers are text, so that leading zeros stay; numbers are read as such."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import DoubleType, StringType, StructField, StructType


@dataclass(frozen=True)
class Table:
    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()

    def schema(self, header: list[str]) -> StructType:
        return StructType([StructField(c, DoubleType() if c in self.numbers else StringType()) for c in header])


# The column names of the three inputs.
OFFERS = Table(
    "offers",
    ("Offer Name", "Product", "Brand Name", "Variant", "Base Packsize", "Country", "Retailer Name", "Flyer Name", "offerid", "Offer Price", "Regular Price"),
    ("Analysis week", "segment", "Discount_percent"),
    ("Offer Price", "Regular Price", "Discount_percent"),
)
MASTER = Table("product master", ("Itemcode", "Itemname", "Item-Cat-2", "Item-Cat-4", "Item Description", "Item-Spec"))
GOLD = Table(
    "labelled pairs",
    ("offer_group_id", "offer_text", "master_itemcode", "pair_label", "use_for_binary_pair_training"),
    ("record_id", "source_dataset", "product_class_offer", "variant_offer", "recommended_split", "split_group", "label_provenance", "label_confidence"),
)

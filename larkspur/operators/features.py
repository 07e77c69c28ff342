"""The 19 features of an offer and a catalogue row, in fixed order; missing values are null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import measures as m
from ..functions import similarity as s
from ..functions import text as t

#: The model's columns in order.
FEATURES = [
    "protein_match", "family_match", "variant_match", "size_match", "pack_format_match", "word_similarity", "character_similarity",
    "token_similarity", "unit_pack_weight_g", "number_of_units", "bonus_weight_g", "total_offer_weight_g", "piece_count",
    "master_unit_weight_g", "master_units_per_carton", "is_mixed_protein_offer", "is_multi_family_offer",
    "contains_non_meat_product", "expected_match_count",
]


def add_features(pairs: DataFrame, own_brand: str | None = None) -> DataFrame:
    """pairs with FEATURES. Texts come from the offer's and the catalogue's columns; measures that
    are there already are used, others are parsed. Rounding is half to even, to one place."""
    has = set(pairs.columns)
    text = lambda names: F.trim(F.concat_ws(" ", *(t.safe(c) if c in has else F.lit("") for c in names)))
    cell = lambda c: t.safe(c) if c in has else F.lit("")
    parsed_o, parsed_m = m.offer_measures(F.concat_ws(" ", cell("Base Packsize"), cell("Offer Name"))), m.master_measures(cell("Item-Spec"))
    df = pairs.withColumns({
        "__o": text(["Offer Name", "Product", "Variant"]),
        "__m": text(["Itemname", "Item-Cat-4", "Item Description"]),
        "__spec": cell("Item-Spec"),
        "__om": F.coalesce("offer_measures_detailed", parsed_o) if "offer_measures_detailed" in has else parsed_o,
        "__mm": F.coalesce("master_measures_detailed", parsed_m) if "master_measures_detailed" in has else parsed_m,
    })
    o, w, om, mm = F.col("__o"), F.col("__m"), F.col("__om"), F.col("__mm")
    df = df.withColumn("__s", s.similarities(t.clean_offer(o, own_brand), t.clean_offer(w, own_brand)))
    one = lambda c: F.bround(c, 1)
    df = df.withColumns({
        "protein_match": t.agree(t.proteins(o), t.proteins(w)),
        "family_match": t.agree(t.families(o), t.families(w)),
        "variant_match": t.agree(t.variants(o), t.variants(w)),
        "size_match": F.coalesce(m.pack_compatible(m.simple(om), m.simple(mm)), F.lit(False)).cast("int"),
        "pack_format_match": F.coalesce(m.pack_structure(om, mm), F.lit(True)).cast("int"),
        "word_similarity": one(F.col("__s.words")),
        "character_similarity": one(F.col("__s.characters")),
        "token_similarity": one(F.col("__s.weighted")),
        "unit_pack_weight_g": m.retail_weight(om),
        "number_of_units": m.unit_count(om),
        "bonus_weight_g": m.bonus_weight(o),
        "total_offer_weight_g": m.total_weight(om),
        "piece_count": m.piece_count(o),
        "master_unit_weight_g": m.retail_weight(mm),
        "master_units_per_carton": m.units_per_carton(F.col("__spec")),
        "is_mixed_protein_offer": (F.size(t.proteins(o)) > 1).cast("int"),
        "is_multi_family_offer": (F.size(t.families(o)) > 1).cast("int"),
        "contains_non_meat_product": t.has_non_meat(o),
        "expected_match_count": t.expected_matches(o),
    })
    return df.drop("__o", "__m", "__spec", "__om", "__mm", "__s")

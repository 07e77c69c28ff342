"""Training features from labelled pairs: accepted rows with features, rejected rows with reasons."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources import readers, sinks
from .audit import audit, imbalance
from .features import FEATURES, add_features
from .prepare import prepare_master
from .validate import require_columns, validate_gold_for_audit, validate_master

# Columns of the training table before the features, and those of an offer that features use.
METADATA = ["record_id", "offer_group_id", "offer_text", "master_itemcode", "pair_label", "source_dataset", "label_provenance", "label_confidence", "recommended_split", "split_group", "product_class_offer", "variant_offer"]
OFFER_COLUMNS = ["Offer Name", "Product", "Variant", "Base Packsize"]


@dataclass
class Built:
    """Accepted and rejected rows, lazy; numbers about them are counted when they are first asked for."""

    accepted: DataFrame
    rejected: DataFrame
    rows: DataFrame
    joined: DataFrame
    gold: DataFrame
    master: DataFrame
    more: dict
    output_paths: dict[str, str] = field(default_factory=dict)

    @cached_property
    def audit(self) -> dict:
        return audit(self.gold, self.master)

    @cached_property
    def counts(self) -> dict:
        return totals(self.rows).first().asDict()

    @cached_property
    def eligible_binary_rows(self) -> int:
        return self.counts["eligible"]

    @cached_property
    def offer_reconstruction_counts(self) -> dict[str, int]:
        n = self.joined.agg(F.count_if("exact_offer").alias("exact"), F.count_if(~F.col("exact_offer")).alias("text")).first()
        return {"exact_offer": n["exact"], "synthetic_or_text_fallback": n["text"]}

    def _distribution(self, column: str) -> dict[str, int]:
        """Accepted rows by the values of a column, the most frequent ones."""
        return imbalance(self.accepted, F.col(column))["distribution"] if column in self.accepted.columns else {}

    @cached_property
    def manifest(self) -> dict:
        n, reasons = self.counts, {r["reason"]: r["n"] for r in exclusions(self.rows).orderBy("reason").collect()}
        return self.more | {
            "total_rows": n["n"], "eligible_binary_rows": n["eligible"], "accepted_rows": n["n"] - n["rejected"], "rejected_rows": n["rejected"], "exclusion_reasons": reasons,
            **{f"{name}_distribution": self._distribution(c) for name, c in (("class", "pair_label"), ("source", "source_dataset"), ("provenance", "label_provenance"))},
            "offer_reconstruction": self.offer_reconstruction_counts, "feature_columns": FEATURES, "feature_schema": {c: k for c, k in self.accepted.dtypes if c in FEATURES},
        }


def totals(rows: DataFrame) -> DataFrame:
    """All judged rows, those with a flag and a label of 0 or 1 whatever else is wrong, rejected ones."""
    return rows.agg(F.count("*").alias("n"), F.count_if(F.expr("flag = 1 and label in (0, 1)")).alias("eligible"), F.count_if(F.size("reasons") > 0).alias("rejected"))


def exclusions(rows: DataFrame) -> DataFrame:
    """How many judged rows have each reason; a row counts for each of its own."""
    return rows.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def judged(gold: DataFrame, master: DataFrame) -> DataFrame:
    """gold with flag, label, code and an array of reasons for rejection, in a fixed order."""
    known = master.select(F.col("Itemcode").alias("code")).where("code is not null").distinct().withColumn("known", F.lit(True))
    df = gold.withColumns({"flag": t.training_flag(F.col("use_for_binary_pair_training")), "label": t.pair_label(F.col("pair_label")), "code": t.itemcode(F.col("master_itemcode"))}).join(known, "code", "left")
    flag, label, code = F.col("flag"), F.col("label"), F.col("code")
    valid = F.coalesce(label.isin(-1, 0, 1), F.lit(False))
    reasons = F.array(
        F.when(flag.isNull(), "invalid_use_for_binary_pair_training").when(flag != 1, "use_for_binary_pair_training_not_1"),
        F.when(~valid, "invalid_pair_label").when(label == -1, "abstain_pair_label"),
        F.when(t.identity_text(F.col("offer_text")) == "", "null_offer_text"),
        F.when(code.isNull(), "missing_master_itemcode").when(F.col("known").isNull(), "unknown_master_itemcode"),
    )
    return df.withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull()))


def reliable_offers(offers: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Offers whose text (and, if there are retailers, whose text and retailer) stands for one set of
    columns; ambiguous ones are left out."""
    require_columns(offers, OFFER_COLUMNS, "offers")
    meta = F.struct(*(F.trim(t.safe(c)).alias(f"f{i}") for i, c in enumerate(OFFER_COLUMNS)))
    df = offers.select(meta.alias("meta"), t.identity_text(F.col("Offer Name")).alias("text_key"), *([t.identity_text(F.col("Retailer Name")).alias("retailer_key")] if "Retailer Name" in offers.columns else []))
    single = lambda d, keys: d.groupBy(*keys).agg(F.min("meta").alias("meta"), F.max("meta").alias("__m")).where("meta = __m").drop("__m")
    by_text = single(df.where("text_key <> ''"), ["text_key"])
    return by_text, single(df.where("retailer_key <> ''"), ["text_key", "retailer_key"]) if "Retailer Name" in offers.columns else None


def reconstructed(gold: DataFrame, offers: DataFrame | None) -> DataFrame:
    """gold with the offer's columns: from an exact offer where it is reliable and the row isn't
    synthetic, else from the row's own text, product class and variant."""
    cell = lambda c: t.safe(c) if c in gold.columns else F.lit("")
    own = F.struct(cell("offer_text").alias("f0"), cell("product_class_offer").alias("f1"), cell("variant_offer").alias("f2"), F.lit("").alias("f3"))
    df = gold.withColumns({"text_key": t.identity_text(F.col("offer_text")), "retailer_key": t.identity_text(F.col("retailer")) if "retailer" in gold.columns else F.lit("")})
    exact = F.lit(None).cast("struct<f0: string, f1: string, f2: string, f3: string>")
    if offers is not None:
        by_text, by_both = reliable_offers(offers)
        df = df.join(by_text.withColumnRenamed("meta", "__text"), "text_key", "left")
        exact = F.when(F.col("retailer_key") == "", F.col("__text"))
        if by_both is not None:
            df = df.join(by_both.withColumnRenamed("meta", "__both"), ["text_key", "retailer_key"], "left")
            exact = F.when(F.col("retailer_key") == "", F.col("__text")).otherwise(F.col("__both"))
    exact = F.when(~t.synthetic(cell("source_dataset"), cell("label_provenance")), exact)
    df = df.withColumn("__exact", exact).withColumn("exact_offer", F.col("__exact").isNotNull()).withColumn("__meta", F.coalesce("__exact", own))
    return df.withColumns({c: F.col(f"__meta.f{i}") for i, c in enumerate(OFFER_COLUMNS)}).drop("__exact", "__meta", "__text", "__both", "text_key", "retailer_key")


def featured_once(joined: DataFrame, own_brand: str | None = None) -> DataFrame:
    """joined with FEATURES, which are made once for each distinct set of what they depend on: labelled
    pairs repeat a few texts and catalogue rows."""
    inputs = [c for c in (*OFFER_COLUMNS, "offer_measures_detailed", "Itemname", "Item-Cat-4", "Item Description", "Item-Spec", "master_measures_detailed") if c in joined.columns]
    once = add_features(joined.select(*inputs).distinct(), own_brand).withColumnsRenamed({c: f"__{c}" for c in inputs})
    same = F.lit(True)
    for c in inputs:
        same &= joined[c].eqNullSafe(once[f"__{c}"])
    return joined.join(once, same).drop(*(f"__{c}" for c in inputs))


def build(gold: DataFrame, master: DataFrame, offers: DataFrame | None = None, own_brand: str | None = None, **manifest) -> Built:
    gold = validate_gold_for_audit(gold)
    master = prepare_master(validate_master(master))
    rows = judged(gold, master)
    rejected = rows.where(F.size("reasons") > 0).select(*gold.columns, F.array_join("reasons", ";").alias("rejection_reason"))
    good = rows.where(F.size("reasons") == 0).drop("reasons", "known", "flag")
    joined = reconstructed(good, offers).join(master.withColumnRenamed("Itemcode", "code").select("code", "Itemname", "Item-Cat-4", "Item Description", "Item-Spec", "master_measures_detailed"), "code")
    metadata = [c for c in METADATA if c in gold.columns]
    featured = featured_once(joined, own_brand)
    accepted = featured.withColumns({"master_itemcode": F.col("code"), "pair_label": F.col("label")}).select(*metadata, *FEATURES)
    return Built(accepted, rejected, rows, joined, gold, master, manifest)


def build_from_paths(spark: SparkSession, gold_path: str, master_path: str, offers_path: str | None = None, output_dir: str | None = None, own_brand: str | None = None, encoding: str = "utf-8-sig", overwrite: bool = False) -> Built:
    """Read the tables, build, and write all artifacts if a folder is given; the manifest says where the
    inputs lie and, for files on this machine, their hashes."""
    paths = {"gold": gold_path, "master": master_path} | ({"offers": offers_path} if offers_path else {})
    hashes = {k: sinks.file_sha256(p) for k, p in paths.items() if os.path.isfile(p)}
    offers = readers.load_offers(spark, offers_path) if offers_path else None
    gold, master = readers.load_gold_for_audit(spark, gold_path), readers.load_master(spark, master_path)
    built = build(gold, master, offers, own_brand, input_filenames=paths, input_hashes=hashes, timestamp=datetime.now(UTC).isoformat())
    if output_dir:
        sinks.write_training(built, output_dir, encoding, overwrite)
    return built

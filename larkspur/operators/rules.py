"""Confidence tiers before a model, and decisions after one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .candidates import NONE

REVIEW = "REVIEW_REQUIRED"


@dataclass(frozen=True)
class Thresholds:
    """Scores and margins, compared before rounding."""

    other_score: float = 85.0
    other_margin: float = 12.0
    least_score: float = 55.0
    high_score: float = 80.0
    high_margin: float = 8.0
    medium_score: float = 65.0
    medium_margin: float = 6.0
    auto_match: float = 0.95
    manual_review: float = 0.70


def tiers(found: DataFrame, at: Thresholds = Thresholds()) -> DataFrame:
    """Candidates with their tier; those below the least score become no match, with scores kept."""
    score, margin, fits = F.col("text_score"), F.col("margin"), F.col("pack_status")
    none = F.col("itemcode") == NONE
    other = F.col("category") == "Other"
    weak = ~none & F.when(other, (score < at.other_score) | (margin < at.other_margin)).otherwise(score < at.least_score)
    tier = (
        F.when(none, F.col("confidence_tier"))
        .when(weak, "no_match")
        .when(F.col("all_candidates_incompatible"), "low_pack_conflict")
        .when(F.col("pack_structure_status") == F.lit(False), "low_structure_conflict")
        .when(fits == F.lit(False), "low")
        .when((score >= at.high_score) & (margin >= at.high_margin) & fits, "high")
        .when((score >= at.medium_score) & (F.coalesce(fits, F.lit(False)) | (margin >= at.medium_margin)), "medium")
        .otherwise("low")
    )
    return found.withColumn("__weak", weak).withColumns({
        "confidence_tier": tier,
        "itemcode": F.when(F.col("__weak"), NONE).otherwise(F.col("itemcode")),
        "itemname": F.when(F.col("__weak"), "None").otherwise(F.col("itemname")),
        "master_match_text": F.when(F.col("__weak"), "").otherwise(F.col("master_match_text")),
        "master_measures": F.when(F.col("__weak"), F.array().cast("array<struct<v: double, d: string>>")).otherwise(F.col("master_measures")),
    }).drop("__weak")


def decision(code: Column, known: Column, probability: Column, at: Thresholds = Thresholds()) -> Column:
    """NO_CANDIDATE, MASTER_SKU_NOT_FOUND, AUTO_MATCH, MANUAL_REVIEW or NO_MATCH."""
    missing = code.isNull() | F.trim(code).isin("", NONE, REVIEW, "nan")
    return F.when(missing, "NO_CANDIDATE").when(~known, "MASTER_SKU_NOT_FOUND").when(probability >= at.auto_match, "AUTO_MATCH").when(probability >= at.manual_review, "MANUAL_REVIEW").otherwise(NONE)


def decided(df: DataFrame) -> DataFrame:
    """Tier and matched item by ml_decision: only AUTO_MATCH is accepted, suggestions stay."""
    ml = F.col("ml_decision")
    auto = ml == "AUTO_MATCH"
    tier = F.when(auto, "high (ml)").when(ml == "MANUAL_REVIEW", "medium (ml)").when(ml == NONE, "low (ml)").otherwise(F.col("confidence_tier"))
    return df.withColumns({"confidence_tier": tier, "matched_itemcode": F.when(auto, F.col("suggested_itemcode")).otherwise(REVIEW), "matched_itemname": F.when(auto, F.col("suggested_itemname")).otherwise(REVIEW)})

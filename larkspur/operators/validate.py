"""Checks of input tables. Those on data are one aggregate each; only offending examples come back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.schemas import GOLD, MASTER, OFFERS


class InputValidationError(ValueError):
    """An input table breaks its contract."""


class EmptyInputError(InputValidationError):
    """An input table has no rows."""


class DuplicateItemCodeError(InputValidationError):
    """Two catalogue rows have one code after normalisation."""


def require_columns(df: DataFrame, columns: list[str] | tuple[str, ...], name: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise InputValidationError(f"{name} is missing required columns: {', '.join(missing)}")


def require_rows(df: DataFrame, name: str) -> None:
    if df.isEmpty():
        raise EmptyInputError(f"{name} has no rows")


def validate_offers(df: DataFrame) -> DataFrame:
    require_columns(df, OFFERS.required, OFFERS.name)
    require_rows(df, OFFERS.name)
    return df.withColumn("offerid", F.col("offerid").cast("string"))


def validate_master(df: DataFrame) -> DataFrame:
    """Catalogue with normalised codes; a code that stands twice is an error."""
    require_columns(df, MASTER.required, MASTER.name)
    require_rows(df, MASTER.name)
    out = df.withColumn("Itemcode", t.itemcode(F.col("Itemcode")))
    twice = out.where("Itemcode is not null").groupBy("Itemcode").count().where("count > 1").orderBy("Itemcode").limit(5).collect()
    if twice:
        raise DuplicateItemCodeError("duplicate Itemcode: " + ", ".join(r["Itemcode"] for r in twice))
    return out


def validate_gold_for_audit(df: DataFrame) -> DataFrame:
    """Only columns and rows are checked: bad rows stay, to be audited or rejected."""
    require_columns(df, GOLD.required, GOLD.name)
    require_rows(df, GOLD.name)
    return df


def validate_gold(df: DataFrame) -> DataFrame:
    """Strict form: labels are -1, 0 or 1, flags are 0 or 1, both as integers; codes are normalised."""
    out = validate_gold_for_audit(df).withColumns({
        "__label": t.pair_label(F.col("pair_label")),
        "__flag": t.training_flag(F.col("use_for_binary_pair_training")),
    })
    bad = out.agg(F.count_if(~F.coalesce(F.col("__label").isin(-1, 0, 1), F.lit(False))).alias("label"), F.count_if(F.col("__flag").isNull()).alias("flag")).first()
    if bad["label"]:
        raise InputValidationError(f"pair_label is not -1, 0 or 1 in {bad['label']} rows")
    if bad["flag"]:
        raise InputValidationError(f"use_for_binary_pair_training is not 0 or 1 in {bad['flag']} rows")
    return out.withColumns({"pair_label": F.col("__label"), "use_for_binary_pair_training": F.col("__flag"), "master_itemcode": t.itemcode(F.col("master_itemcode"))}).drop("__label", "__flag")

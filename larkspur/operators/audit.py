"""Audit of labelled pairs: reports, never deletes. Every section is a DataFrame; audit() makes small
driver-side numbers and examples of them, from one stored copy of the pairs in normal form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..sources.scratch import stored

PAIR = ["offer_group_id", "code"]
#: Rows of an example, and values that a report lists at most; their number is given beside them.
EXAMPLES, LISTED = 100, 100_000


def normalized(gold: DataFrame) -> DataFrame:
    """gold with text, code and label in normal form, in columns text_norm, code and label."""
    return gold.withColumns({"text_norm": t.identity_text(F.col("offer_text")), "code": t.itemcode(F.col("master_itemcode")), "label": t.pair_label(F.col("pair_label"))})


def over(keys: list[str], value: Column) -> Column:
    return value.over(Window.partitionBy(*keys))


def duplicate_pairs(df: DataFrame) -> DataFrame:
    return df.withColumn("__n", over(PAIR, F.count("*"))).where("__n > 1").drop("__n")


def conflicting_labels(df: DataFrame) -> DataFrame:
    """Rows of pairs with more than one label: their smallest and largest differ."""
    return df.withColumn("__d", over(PAIR, F.max("label")) > over(PAIR, F.min("label"))).where("__d").drop("__d")


def groups_across_splits(df: DataFrame) -> DataFrame:
    own = F.nullif(F.trim(F.col("recommended_split").cast("string")), F.lit(""))
    keyed = df.withColumn("__s", own)
    return keyed.withColumn("__d", over(["offer_group_id"], F.max("__s")) > over(["offer_group_id"], F.min("__s"))).where("__d").drop("__d", "__s")


def invalid_labels(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce(F.col("label").isin(-1, 0, 1), F.lit(False)))


def unknown_codes(df: DataFrame, master: DataFrame) -> DataFrame:
    return df.join(master.select(F.col("Itemcode").alias("code")).distinct(), "code", "left_anti")


def codes_of(df: DataFrame) -> DataFrame:
    """Each code once."""
    return df.where("code is not null").select("code").distinct()


def empty_texts(df: DataFrame) -> DataFrame:
    return df.where("text_norm = ''")


def repeated_synthetic(df: DataFrame) -> DataFrame:
    has = [F.col(c) for c in ("source_dataset", "label_provenance") if c in df.columns]
    if not has:
        return df.limit(0)
    return df.where(t.synthetic(*has) & (F.col("text_norm") != "")).withColumn("__n", over(["text_norm"], F.count("*"))).where("__n > 1").drop("__n")


def exact_duplicates(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumn("__n", over(columns, F.count("*"))).where("__n > 1").drop("__n")


def distribution(df: DataFrame, column: Column) -> DataFrame:
    return df.groupBy(F.coalesce(column.cast("string"), F.lit("<missing>")).alias("value")).agg(F.count("*").alias("n"))


def majority(counts: DataFrame) -> DataFrame:
    return counts.agg(F.bround(F.max("n") / F.sum("n"), 6).alias("majority_fraction"))


def imbalance(df: DataFrame, column: Column) -> dict:
    """Share of the most frequent value, and the counts of the LISTED most frequent ones."""
    counts = distribution(df, column)
    listed = {r["value"]: r["n"] for r in counts.orderBy(F.desc("n"), "value").limit(LISTED).collect()}
    return {"distribution": dict(sorted(listed.items())), "majority_fraction": majority(counts).first()[0]}


def first_examples(df: DataFrame, columns: list[str]) -> DataFrame:
    """The first EXAMPLES rows, with those of the columns that are there."""
    order = [c for c in ("gold_ord", "record_id", "offer_group_id") if c in df.columns]
    return df.orderBy(*order).select(*(c for c in columns if c in df.columns)).limit(EXAMPLES)


def examples(df: DataFrame, columns: list[str]) -> list[dict]:
    return [r.asDict() for r in first_examples(df, columns).collect()]


def audit(gold: DataFrame, master: DataFrame) -> dict:
    """All sections with counts and up to 100 examples each."""
    df = stored(normalized(gold))
    pair_cols = ["record_id", "offer_group_id", "offer_text", "master_itemcode", "pair_label"]
    split = groups_across_splits(df) if "recommended_split" in df.columns else df.limit(0)
    unknown, synthetic_rows, twice, conflict, exact = unknown_codes(df, master), repeated_synthetic(df), duplicate_pairs(df), conflicting_labels(df), exact_duplicates(df, gold.columns)
    groups = lambda d, keys: d.select(*keys).distinct().count()
    column = lambda c: F.col(c) if c in df.columns else F.lit(None)
    keep = "report_and_retain_when_otherwise_eligible"
    return {
        "total_rows": df.count(),
        "policy": {"duplicate_pairs": keep, "conflicting_labels": keep, "exact_duplicates": keep, "invalid_or_ineligible_rows": "write_to_rejected_training_rows"},
        "duplicate_offer_master_pairs": {"group_count": groups(twice, PAIR), "row_count": twice.count(), "examples": examples(twice, pair_cols)},
        "conflicting_labels": {"pair_count": groups(conflict, PAIR), "row_count": conflict.count(), "examples": examples(conflict, pair_cols)},
        "offer_groups_across_recommended_splits": {"group_count": groups(split, ["offer_group_id"]), "row_count": split.count(), "examples": examples(split, ["record_id", "offer_group_id", "recommended_split"])},
        "invalid_labels": {"row_count": invalid_labels(df).count(), "examples": examples(invalid_labels(df), ["record_id", "offer_group_id", "master_itemcode", "pair_label"])},
        "unknown_master_skus": {"row_count": unknown.count(), "unique_code_count": codes_of(unknown).count(), "unique_codes": [r["code"] for r in codes_of(unknown).orderBy("code").limit(LISTED).collect()], "examples": examples(unknown, ["record_id", "offer_group_id", "master_itemcode"])},
        "null_offer_text": {"row_count": empty_texts(df).count(), "examples": examples(empty_texts(df), ["record_id", "offer_group_id", "master_itemcode"])},
        "class_imbalance": imbalance(df, F.col("label")),
        "source_imbalance": imbalance(df, column("source_dataset")),
        "provenance_imbalance": imbalance(df, column("label_provenance")),
        "repeated_synthetic_templates": {"template_count": groups(synthetic_rows, ["text_norm"]), "row_count": synthetic_rows.count(), "examples": examples(synthetic_rows, ["record_id", "offer_group_id", "offer_text", "master_itemcode"])},
        "exact_duplicate_rows": {"row_count": exact.count(), "examples": examples(exact, pair_cols)},
    }

"""Probability scorers: any function from a DataFrame with the features to a column of probabilities.

A gradient-boosted classifier of Spark ML can be trained, saved with its metadata, loaded and checked
against the feature order. The rule scorer is a stand-in for tests and examples, not a trained model.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .features import FEATURES

Scorer = Callable[[DataFrame], DataFrame]


def rule_scorer(df: DataFrame) -> DataFrame:
    """A fixed mixture of similarity, size and category flags between 0 and 1."""
    p = 0.005 * F.col("word_similarity") + 0.3 * F.col("size_match") + 0.1 * F.col("pack_format_match") + 0.1 * F.col("protein_match") * F.col("family_match")
    return df.withColumn("ml_probability", F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))


def with_split(df: DataFrame, group: str = "offer_group_id", seed: int = 42, train: int = 70, valid: int = 15) -> DataFrame:
    """`recommended_split` where it is valid, else a split by a hash of the group: no group is cut."""
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col(group).cast("string"), F.lit("")), F.lit(str(seed))))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100
    made = F.when(bucket < train, "train").when(bucket < train + valid, "validation").otherwise("test")
    if "recommended_split" in df.columns:
        own = F.lower(F.trim(F.col("recommended_split").cast("string")))
        made = F.coalesce(F.when(own.isin("train", "validation", "test"), own), made)
    return df.withColumn("split", made)


def class_weights(df: DataFrame, label: str = "pair_label", by_source: dict[str, float] | None = None, source: str = "label_provenance") -> DataFrame:
    """Weights that give both classes equal weight in sum; by_source: factors for rows whose provenance
    is the key (in any case), 1 for others."""
    factor = F.lit(1.0)
    for name, x in (by_source or {}).items():
        factor = F.when(F.lower(F.trim(F.col(source).cast("string"))) == name.lower(), float(x)).otherwise(factor)
    df = df.withColumn("weight", factor)
    sums = {r[label]: r["w"] for r in df.groupBy(label).agg(F.sum("weight").alias("w")).collect()}
    total, share = sum(sums.values()), F.lit(1.0)
    for value, w in sums.items():
        share = F.when(F.col(label) == value, total / (len(sums) * w) if w else 0.0).otherwise(share)
    return df.withColumn("weight", F.col("weight") * share)


def numbers(df: DataFrame) -> DataFrame:
    """df with each feature as a number in a column `<feature>__n`: what isn't one, or is missing, is -1
    (a column without any value can't be imputed from its median); a feature that is not there is missing."""
    cell = lambda c: F.col(c).cast("string").try_cast("double") if c in df.columns else F.lit(None).cast("double")
    return df.withColumns({f"{c}__n": F.coalesce(F.when(~F.isnan(cell(c)), cell(c)), F.lit(-1.0)) for c in FEATURES})


def train(accepted: DataFrame, label: str = "pair_label", seed: int = 42, trees: int = 20, by_source: dict[str, float] | None = None) -> PipelineModel:
    names = [f"{c}__n" for c in FEATURES]
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="__x"), GBTClassifier(featuresCol="__x", labelCol=label, weightCol="weight", maxIter=trees, seed=seed)]).fit(numbers(class_weights(accepted, label, by_source)))


def model_scorer(model: PipelineModel) -> Scorer:
    def score(df: DataFrame) -> DataFrame:
        out = model.transform(numbers(df)).withColumn("ml_probability", vector_to_array("probability")[1])
        return out.drop(*(f"{c}__n" for c in FEATURES), "__x", "rawPrediction", "probability", "prediction")

    return score


def save(model: PipelineModel, path: str, **metadata) -> None:
    """Model and metadata.json beside it; an existing package is never overwritten."""
    spark = SparkSession.getActiveSession()
    model.write().save(f"{path}/model")
    spark.createDataFrame([(json.dumps({"feature_columns": FEATURES} | metadata, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/metadata")


def load(spark, path: str) -> tuple[Scorer, dict]:
    """Scorer and metadata; other feature columns than FEATURES are an error."""
    metadata = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    if metadata.get("feature_columns") != FEATURES:
        raise ValueError("the model package was made for other feature columns")
    return model_scorer(PipelineModel.load(f"{path}/model")), metadata


def threshold_sweep(scored: DataFrame, label: str = "pair_label", cuts: list[float] | None = None) -> DataFrame:
    """For each cut: counts of the confusion table, precision, recall and F1. Rows are counted once by
    the largest cut that they reach, then added up over the cuts: no row is repeated."""
    cuts = sorted(cuts or [i / 20 for i in range(1, 20)])
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col("ml_probability") >= c))
    counts = scored.where(F.col("ml_probability").isNotNull()).groupBy(at.alias("reached")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    grid = scored.sparkSession.createDataFrame([(c, i + 1) for i, c in enumerate(cuts)], "threshold double, at int")
    sums = grid.join(F.broadcast(counts)).groupBy("threshold", "at")  # both sides have one row for each cut at most
    over = lambda c, yes: F.coalesce(F.sum(F.when((F.col("reached") >= F.col("at")) == F.lit(yes), F.col(c))), F.lit(0))
    out = sums.agg(over("p", True).alias("tp"), over("n", True).alias("fp"), over("p", False).alias("fn"), over("n", False).alias("tn")).drop("at")
    share = lambda a, b: F.when(b > 0, a / b)
    out = out.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


#: Bins of probabilities: ranks and areas are counted bin by bin, then within each.
BINS = 4096


def steps(scored: DataFrame, label: str, by: list[str]) -> DataFrame:
    """Positives and negatives of each distinct probability, and how many negatives lie under it and how
    many of both above it. Sums run in bins of the probability, so that no slice is one task's work; those
    of whole bins come from a table of one row for each bin and slice."""
    rows = scored.where(F.col("ml_probability").isNotNull() & F.col(label).isin(0, 1))
    each = rows.groupBy(*by, "ml_probability").agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    each = each.withColumn("__bin", F.floor(F.col("ml_probability") * BINS).cast("int"))
    below = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(*by).orderBy(F.desc("__bin")).rowsBetween(Window.unboundedPreceding, -1)
    over = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    whole = each.groupBy(*by, "__bin").agg(F.sum("p").alias("__p"), F.sum("n").alias("__n"))
    whole = whole.select(*(F.col(c).alias(f"__of_{c}") for c in (*by, "__bin")), over("__n", below).alias("__nb"), over("__p", above).alias("__pa"), over("__n", above).alias("__na"))
    low = Window.partitionBy(*by, "__bin").orderBy("ml_probability").rowsBetween(Window.unboundedPreceding, -1)
    high = Window.partitionBy(*by, "__bin").orderBy(F.desc("ml_probability")).rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumns({"under": over("n", low), "__ph": over("p", high), "__nh": over("n", high)})
    same = F.lit(True)
    for c in (*by, "__bin"):
        same &= F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return each.join(whole, same).select(*by, "ml_probability", "p", "n", (F.col("under") + F.col("__nb")).alias("under"), (F.col("__ph") + F.col("__pa")).alias("hits"), (F.col("__nh") + F.col("__na")).alias("misses"))


def metrics(scored: DataFrame, label: str = "pair_label", cut: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """Areas under the ROC curve (by ranks, ties count half) and under the curve of precision and recall
    (average precision: each step of recall at its precision), and rates at a cut, for each slice."""
    by = by or []
    each = steps(scored, label, by)
    hit = lambda c, yes: F.sum(F.when((F.col("ml_probability") >= cut) == F.lit(yes), F.col(c)).otherwise(0))
    reached = F.col("hits") + F.col("p")
    out = each.groupBy(*by).agg(
        F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.sum(F.col("p") * (F.col("under") + F.col("n") / 2)).alias("__u"),
        F.sum(F.col("p") * reached / (reached + F.col("misses") + F.col("n"))).alias("__a"),
        hit("p", True).alias("tp"), hit("n", True).alias("fp"), hit("p", False).alias("fn"), hit("n", False).alias("tn"),
    )
    share = lambda a, b: F.when(b > 0, a / b)
    return out.withColumns({
        "roc_auc": share(F.col("__u"), F.col("positives") * F.col("negatives")),
        "pr_auc": share(F.col("__a"), F.col("positives")),
        "precision": share(F.col("tp"), F.col("tp") + F.col("fp")),
        "recall": share(F.col("tp"), F.col("positives")),
        "f1": share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
        "false_positive_rate": share(F.col("fp"), F.col("negatives")),
        "false_negative_rate": share(F.col("fn"), F.col("positives")),
    }).drop("__u", "__a")


def calibration(scored: DataFrame, label: str = "pair_label", bins: int = 10) -> DataFrame:
    """For each bin of probabilities: rows, mean probability and share of label 1."""
    rows = scored.where(F.col("ml_probability").isNotNull() & F.col(label).isin(0, 1))
    at = F.least(F.floor(F.col("ml_probability") * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("ml_probability").alias("mean_probability"), F.avg(F.col(label).cast("double")).alias("share"))

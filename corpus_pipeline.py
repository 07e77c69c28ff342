"""A training corpus from raw documents in five stages: rejected documents go, one document of each
group of near copies stays, passages that repeat are cut out, personal data are masked, and what is
left is packed into sequences. Each stage reads all rows that the one before it kept; the stages
between are written as Parquet to the folder that the cluster shares, and read again.

Cases: a null text counts as empty; an empty table gives empty stages; rows with null or repeated ids
are documents of their own (equal ones are near copies, of which one stays); very long texts are taken
whole; columns beyond those of documents are dropped, and a column of documents that is missing comes
back as null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import jaccard, packing, pii, quality, substring
from larkspur.llm.bpe import tokenizer_path
from larkspur.llm.common import stored

COLUMNS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
#: Least quality score of a document that stays.
LEAST_QUALITY = 0.3


def shaped(docs: DataFrame) -> DataFrame:
    return docs.select(*((F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject, unchanged."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return shaped(quality.score(shaped(docs), labels, ~F.expr(quality.HELD_OUT)).where(F.col("score") >= LEAST_QUALITY))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies, unchanged."""
    return shaped(jaccard.first_documents(shaped(docs)))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the words that repeated passages cover; others keep their text as it is."""
    cut = substring.strip(shaped(docs))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    return shaped(cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")))


def private_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their personal data masked."""
    return shaped(pii.mask(pii.find(shaped(docs))).withColumn("n_chars", F.length("text").cast("long")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return packing.pack_documents(shaped(docs), tokenizer_path())


STAGES = [
    ("quality", quality_stage),
    ("near_copies", near_copy_stage),
    ("repeats", repeats_stage),
    ("private", private_stage),
    ("packing", packing_stage),
]

#: No stage but the masking of base spans could be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs

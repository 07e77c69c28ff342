"""Readers of offers, catalogue and labelled pairs. Paths go through Hadoop's file systems, so that
local files and object stores work alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.validate import EmptyInputError, validate_gold, validate_gold_for_audit, validate_master, validate_offers
from .schemas import GOLD, MASTER, OFFERS, Table
from .xlsx import read_xlsx


class UnsupportedFileTypeError(ValueError):
    """The file's suffix isn't one that the reader takes."""


def guard(spark: SparkSession, path: str, suffixes: tuple[str, ...]) -> None:
    """Suffix, existence and size are checked before Spark plans a scan."""
    if not path.lower().endswith(suffixes):
        raise UnsupportedFileTypeError(f"{path}: expected {', '.join(suffixes)}")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        raise FileNotFoundError(f"Input file not found: {path}")
    if system.getContentSummary(place).getLength() == 0:
        raise EmptyInputError(f"{path} is empty")


def read_csv(spark: SparkSession, path: str, table: Table, order: str | None = None) -> DataFrame:
    """All columns of a CSV in their declared types; quoted line breaks are part of a value. `order`
    names a column that numbers the rows as they stand in one file."""
    options = {"header": True, "multiLine": True, "escape": '"', "encoding": "UTF-8"}
    header = spark.read.options(**options).csv(path).columns
    df = spark.read.options(**options).schema(table.schema(header)).csv(path)
    return df.withColumn(order, F.monotonically_increasing_id()) if order else df


def read_table(spark: SparkSession, path: str, table: Table, order: str | None = None) -> DataFrame:
    if path.lower().rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
        return df.withColumn(order, F.monotonically_increasing_id()) if order and order not in df.columns else df
    return read_csv(spark, path, table, order)


def load_offers(spark: SparkSession, path: str) -> DataFrame:
    guard(spark, path, (".csv", ".parquet"))
    return validate_offers(read_table(spark, path, OFFERS, "offer_ord"))


def load_master(spark: SparkSession, path: str) -> DataFrame:
    guard(spark, path, (".xlsx", ".csv", ".parquet"))
    df = read_xlsx(spark, path).withColumnRenamed("__row", "master_ord") if path.lower().endswith(".xlsx") else read_table(spark, path, MASTER, "master_ord")
    return validate_master(df)


def load_gold(spark: SparkSession, path: str) -> DataFrame:
    guard(spark, path, (".csv", ".parquet"))
    return validate_gold(read_table(spark, path, GOLD, "gold_ord"))


def load_gold_for_audit(spark: SparkSession, path: str) -> DataFrame:
    guard(spark, path, (".csv", ".parquet"))
    return validate_gold_for_audit(read_table(spark, path, GOLD, "gold_ord"))

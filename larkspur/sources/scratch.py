"""Tables in the folder that the cluster shares (spark.checkpoint.dir): they cut lineage, and survive
lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names. Where none is set, a temporary one serves a single machine,
    as in tests; executors elsewhere could not read it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or f"{tempfile.gettempdir()}/larkspur-checkpoints").rstrip("/")


def _place(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


#: Lists of the tables that open blocks of temporary() have stored.
_OPEN: list[list[DataFrame]] = []
#: Rows of a file of a table whose rows are about known.
ROWS = 200_000


def stored(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows, written to the shared folder and read again: later steps don't compute them anew. The
    table goes when the application ends, if it isn't dropped before. rows: about how many there are,
    for narrow tables that cost little to make; they are written to as few files as that takes."""
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS)))
    path = f"{shared_dir(df.sparkSession)}/larkspur-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, place = _place(df.sparkSession, path)
    system.deleteOnExit(place)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._larkspur_path = path
    if _OPEN:
        _OPEN[-1].append(out)
    return out


def again(df: DataFrame) -> DataFrame:
    """A stored table, read once more: for plans that bring it together with itself."""
    out = df.sparkSession.read.schema(df.schema).parquet(df._larkspur_path)
    out._larkspur_path = df._larkspur_path
    return out


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The rows with a number of their own, stored, so that the numbers stay: ids may be null or repeated."""
    return stored(df.withColumn(name, F.monotonically_increasing_id()))


#: Rows of about 100 bytes of a table that may be sent to all executors at once, about 40 MB.
FEW = 400_000


def few(df: DataFrame, rows: int = FEW) -> bool:
    """Whether the table has so few rows, counted and not estimated, that all executors can hold it. Larger
    tables are shuffled."""
    return df.limit(rows + 1).count() <= rows


@contextmanager
def temporary():
    """Tables that are stored inside the block go when it ends, for steps that come again and again."""
    mine: list[DataFrame] = []
    _OPEN.append(mine)
    try:
        yield
    finally:
        _OPEN.remove(mine)
        for df in mine:
            dropped(df)


def dropped(df: DataFrame) -> None:
    """Remove a stored table that nothing reads any more."""
    system, place = _place(df.sparkSession, df._larkspur_path)
    system.delete(place, True)


def slices(spark: SparkSession) -> int:
    """Parts that a group of a join on few keys is cut into, so that all tasks have some of it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

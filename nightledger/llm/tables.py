"""Reading the text tables, and tables written to the shared folder between jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightledger.session import brief_shuffles, prepare, scratch
from nightledger.sources import files

#: Text columns reach Python in batches of so many rows, so that a run of long texts stays within a task's memory.
BATCH_ROWS = "200"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/documents.parquet")


def ready(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return prepare(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """The table as written to the shared folder: later jobs read it and do not run what made it again."""
    path = scratch(df.sparkSession, name)
    with brief_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables from ``written`` that nothing is going to read again."""
    for table in tables:
        files.remove(table.sparkSession, table.stored_at)


def unused_prefix(df: DataFrame) -> str:
    """A prefix that no column of the table begins with, for columns added to it on the way."""
    prefix = "__"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


#: Spark's estimate of a table that it knows nothing about is beyond any real size.
UNKNOWN = 1 << 60


def pieces(df: DataFrame, text: str, per_piece: int, least: int = 4) -> int:
    """Into how many parts a table is dealt: one for each ``per_piece`` stored bytes, whatever shuffles are set to.

    Where Spark does not know the stored bytes, half the bytes of the texts are taken for them, by one pass.
    """
    stored = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if stored >= UNKNOWN:
        stored = (df.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0) // 2
    return max(least, -(-stored // per_piece))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))

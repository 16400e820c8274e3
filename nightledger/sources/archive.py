"""The archive: columnar event tables partitioned by day and channel, rewritten as generations."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightledger.functions.times import calendar_columns, event_timestamp
from nightledger.operators.layout import TARGET_ROWS, channel_layout, tasks_for
from nightledger.schema import CHANNEL_COLUMNS, archive_schema, event_schema


def archive_rows(events: DataFrame) -> DataFrame:
    """Landed events with the parsed time, epoch seconds and calendar parts; batch and stream use the same function."""
    ts = event_timestamp(F.col("eventTime"))
    timed = events.withColumn("eventTimeStamp", ts).withColumn(
        "eventUnixTimeStamp", F.unix_timestamp("eventTimeStamp")
    )
    return timed.withColumns(calendar_columns(F.col("eventTimeStamp")))


def write_archive(
    archive: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "append",
    target_rows: int = TARGET_ROWS,
    layout: bool = True,
) -> None:
    """Append rows to a table partitioned by day and channel; ``fmt`` may name any installed table format."""
    rows = channel_layout(archive, target_rows) if layout else archive
    rows.write.format(fmt).mode(mode).partitionBy(*CHANNEL_COLUMNS).save(path)


def read_archive(
    spark: SparkSession,
    path: str,
    event: T.StructType | None = None,
    fmt: str = "parquet",
    days: list[tuple[int, int, int]] | None = None,
) -> DataFrame:
    """The whole archive. The schema is given, so channel names stay text and no file is opened to infer it.

    ``days`` (year, month, day) lists only those days' folders, so that a point query does not list every channel of
    every day first.
    """

    def reader() -> DataFrameReader:
        return spark.read.format(fmt).schema(archive_schema(event or event_schema()))

    if days is None:
        return reader().load(path)
    base = path.rstrip("/")
    try:
        return reader().option("basePath", base).load([f"{base}/year={y}/month={m}/day={d}" for y, m, d in days])
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    # A day without events has no folder: find the others by their partition columns.
    wanted = [(F.col("year") == y) & (F.col("month") == m) & (F.col("day") == d) for y, m, d in days]
    return reader().load(path).filter(reduce(lambda a, b: a | b, wanted, F.lit(False)))


def compact(
    spark: SparkSession,
    source: str,
    target: str,
    event: T.StructType | None = None,
    target_rows: int = TARGET_ROWS,
    fmt: str = "parquet",
) -> None:
    """Rewrite an archive into a new generation: the same rows, one time-ordered file per table partition.

    Partitions above ``target_rows`` rows get several files of consecutive time ranges. Readers move to ``target``
    when the write is done; the source is left as it is.
    """
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("compaction writes a new generation, not the path it reads")
    write_archive(read_archive(spark, source, event, fmt), target, fmt, "errorifexists", target_rows)


def file_layout(archive: DataFrame) -> DataFrame:
    """Per table partition: rows, files, and rows that stand before an earlier row of their file.

    Works on a direct read of a Parquet archive. The window is per file, and files are bounded by the layout; files are
    dealt over as many tasks as their rows need.
    """
    tasks = tasks_for(archive.sparkSession, archive.count())
    in_file = Window.partitionBy("file").orderBy("row_index")
    rows = archive.select(
        *CHANNEL_COLUMNS,
        "eventTimeStamp",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row_index"),
    ).repartition(tasks, "file").withColumn("previous", F.lag("eventTimeStamp").over(in_file))
    return rows.groupBy(*CHANNEL_COLUMNS).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("file").alias("n_files"),
        F.count_if(F.col("previous") > F.col("eventTimeStamp")).alias("n_unordered"),
    )

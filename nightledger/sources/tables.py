"""The exposure tables: event snapshots and keyword values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightledger.operators.sizes import narrow_to
from nightledger.session import scratch

SNAPSHOT_COLUMNS = ["exposure_id", "obs_event_name", "source", "eventname", "eventid", "eventtime", "paramset"]
KEYWORD_COLUMNS = ["exposure_id", "keyword", "value"]


def snapshot_table(snapshot: DataFrame) -> DataFrame:
    """Snapshot rows as they are stored: the parameter set as JSON text, plus the observe date they are filed under."""
    return snapshot.select(
        "exposure_id",
        "obs_event_name",
        "source",
        F.col("eventName").alias("eventname"),
        F.col("eventId").alias("eventid"),
        F.col("eventTimeStamp").alias("eventtime"),
        F.to_json("paramSet").alias("paramset"),
        F.to_date("obs_time").alias("obs_date"),
    )


def _write(rows: DataFrame, path: str, filed_by: list[str], tasks_by: list[str], mode: str) -> None:
    (
        rows.repartitionByRange(*tasks_by)
        .sortWithinPartitions(*filed_by, "exposure_id")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*filed_by)
        .parquet(path)
    )


def staged(rows: DataFrame) -> DataFrame:
    """The rows as written to the shared folder. Range partitioning reads its input twice; this derives them once."""
    path = scratch(rows.sparkSession, "staged")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_snapshots(snapshot: DataFrame, path: str, mode: str = "append") -> None:
    """Store a snapshot by observe date, sorted by exposure so that min/max statistics prune exposure lookups.

    Range partitioning spreads a busy night over many tasks and keeps one exposure's rows together.
    """
    rows = snapshot_table(snapshot)
    _write(rows, path, ["obs_date"], ["obs_date", "exposure_id", "eventid"], mode)


def write_keyword_values(values: DataFrame, path: str, batch_id: int, revision: int | None = None) -> None:
    """Store keyword values under their batch id; writing the same batch again replaces it, also by no rows.

    A table whose batches are revised has a folder per revision in that of the batch.
    """
    folder = f"{path.rstrip('/')}/batch_id={batch_id}" + ("" if revision is None else f"/revision={revision}")
    _write(values, folder, [], ["exposure_id", "keyword"], "overwrite")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_keyword_values(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def keyword_values_of(values: DataFrame, exposure_ids: list[str]) -> DataFrame:
    """Keyword values of a few exposures; the predicate reaches the files' statistics."""
    return values.filter(F.col("exposure_id").isin(*exposure_ids))


def keyword_values_for(values: DataFrame, requests: DataFrame) -> DataFrame:
    """Keyword values of every exposure in a request table. Few requests reach the files' statistics as well."""
    values = narrow_to(values, "exposure_id", requests)
    return values.join(requests.select("exposure_id"), "exposure_id", "left_semi")

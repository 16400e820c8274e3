"""Streaming jobs, run until their input is used up, checked against the batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightledger.functions.times import micro_text
from nightledger.plans import archive_queries as batch
from nightledger.plans import exposure_queries
from nightledger.plans import fixtures as fx
from nightledger.plans.registry import ORACLE, query
from nightledger.session import scratch
from nightledger.sources import archive as store
from nightledger.sources import landing
from nightledger.streaming import convert, exposure

_NOW = {"availableNow": True}


@query("stream_convert", ORACLE["archive_sink"])
def stream_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "converted")
    convert.start_conversion(
        spark, batch.landed(spark, sf_dir), f"{path}/archive", f"{path}/checkpoint", fx.EVENT, trigger=_NOW
    ).awaitTermination()
    return batch._archived(store.read_archive(spark, f"{path}/archive", fx.EVENT))


@query("stream_ingest", fx.sql(f"SELECT {batch._SHOWN} FROM bus", "bus"))
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole bus: telemetry and observe events are two streams, landed by one job under one checkpoint."""
    path = scratch(spark, "ingested")
    schema = fx.table(spark, sf_dir, "events").schema

    def rows() -> DataFrame:
        source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
        return fx.event_columns(source.parquet(sf_dir))

    bus = landing.merge_streams(fx.as_telemetry(rows()), fx.observe_rows(rows()))
    convert.start_ingest(bus, f"{path}/landing", f"{path}/checkpoint", file_events=2000, trigger=_NOW).awaitTermination()
    return batch._shown(landing.read_landing(spark, f"{path}/landing", fx.EVENT))


@query("stream_latest_state", ORACLE["latest_per_key"])
def stream_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fx.run_exposure_stream(spark, sf_dir)
    rows = exposure.read_state(spark, root, fx.PARAMS)
    temperature = F.get(F.get("paramSet.IntKey.values", F.lit(0)), F.lit(0))
    return rows.select(
        "event_key", "eventId", micro_text(F.col("eventTimeStamp")).alias("at"), temperature.alias("temperature")
    )


@query("stream_snapshot", ORACLE["event_snapshot"])
def stream_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fx.run_exposure_stream(spark, sf_dir)
    return exposure_queries._snapshot_columns(exposure.stored_snapshots(spark, root, fx.PARAMS))


@query("stream_keywords", ORACLE["keyword_extract"])
def stream_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fx.run_exposure_stream(spark, sf_dir)
    return exposure.stored_keyword_values(spark, root).select(*exposure_queries._KEYWORDS)

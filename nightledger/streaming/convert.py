"""Continuous landing and conversion of events."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from nightledger.operators.layout import TARGET_ROWS, channel_layout
from nightledger.schema import CHANNEL_COLUMNS
from nightledger.session import brief_shuffles, scratch
from nightledger.sources import files
from nightledger.sources.archive import archive_rows
from nightledger.sources.landing import FILE_EVENTS, landed_events, quarantined, read_landing_stream, stored_schema

#: Folders of the archive that its readers do not see: what a batch writes, and the batches that are done.
INCOMING, DONE = "_incoming", "_done"
#: Tables that are no more than their files; other formats have a log of their own that takes a batch once.
PLAIN_FORMATS = ("parquet", "orc", "json", "avro")
#: Files moved at a time.
MOVERS = 16


def start_ingest(
    events: DataFrame,
    landing: str,
    checkpoint: str,
    file_events: int = FILE_EVENTS,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Land a stream of events as gzip JSON, a batch every two seconds in files of bounded size."""
    return (
        events.writeStream.format("json")
        .option("compression", "gzip")
        .option("maxRecordsPerFile", file_events)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "2 seconds"}))
        .start(landing)
    )


def quarantine_of(archive: str) -> str:
    return f"{archive.rstrip('/')}-quarantine"


def convert_batch(
    rows: DataFrame,
    batch_id: int,
    archive: str,
    quarantine: str | None = None,
    fmt: str = "parquet",
    target_rows: int = TARGET_ROWS,
) -> None:
    """Append one micro-batch, read with its corrupt records, to the archive, and what is no event to the quarantine.

    The batch is parsed once, into the shared folder; every row of it goes to one of the two. A channel with more than
    ``target_rows`` rows in the batch is dealt over several tasks by time; files are time-ordered.

    A batch is archived once, however often it is tried: its files are written where readers do not look, listed, and
    then moved to names that follow from the batch; a later try goes on with the list. A job id and the batch id do the
    same for table formats with a transaction log.
    """
    spark = rows.sparkSession
    archive = archive.rstrip("/")
    name = files.numbered(batch_id, 0)
    if files.exists(spark, f"{archive}/{DONE}/{name}"):
        return
    incoming = f"{archive}/{INCOMING}/{name}"
    if not files.exists(spark, f"{archive}/{INCOMING}/{name}-list"):
        path = scratch(spark, "landed")
        rows.write.parquet(path)
        landed = spark.read.schema(rows.schema).parquet(path)
        bad = f"{quarantine or quarantine_of(archive)}/batch_id={batch_id}"
        quarantined(landed).write.mode("overwrite").parquet(bad)
        placed = channel_layout(archive_rows(landed_events(landed)), target_rows)
        writer = placed.write.format(fmt).partitionBy(*CHANNEL_COLUMNS)
        if fmt not in PLAIN_FORMATS:
            writer.mode("append").option("txnAppId", archive).option("txnVersion", batch_id).save(archive)
        else:
            with brief_shuffles(spark):
                writer.mode("overwrite").save(incoming)
            listed = {"files": files.files_below(spark, incoming)}
            files.write_json(spark, f"{archive}/{INCOMING}", f"{name}-list", listed)
        files.remove(spark, path)
    if fmt in PLAIN_FORMATS:

        def move(numbered: tuple[int, str]) -> None:
            folder, _, last = numbered[1].rpartition("/")
            target = f"{archive}/{folder}/batch-{batch_id:012d}-{numbered[0]:06d}.{last.partition('.')[2]}"
            files.move(spark, f"{incoming}/{numbered[1]}", target)

        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(move, enumerate(files.read_json(spark, f"{archive}/{INCOMING}/{name}-list")["files"])))
    files.make_folder(spark, f"{archive}/{DONE}")
    files.write_json(spark, f"{archive}/{DONE}", name, {"batch_id": batch_id})
    files.remove(spark, incoming)


def start_conversion(
    spark: SparkSession,
    landing: str,
    archive: str,
    checkpoint: str,
    schema: T.StructType | str | None = None,
    fmt: str = "parquet",
    files_per_trigger: int = 300,
    delete_consumed: bool = False,
    trigger: dict | None = None,
    quarantine: str | None = None,
    target_rows: int = TARGET_ROWS,
) -> StreamingQuery:
    """Turn landed files into the partitioned archive every five minutes; see ``convert_batch``.

    Torn records and those that name no channel go to ``quarantine``, by default a folder beside the archive, so nothing
    is lost when consumed files are deleted. A checkpoint belongs to one archive. ``schema`` may name a folder of stored
    schemas, of which the newest is taken.
    """
    schema = stored_schema(spark, schema) if isinstance(schema, str) else schema
    landed = read_landing_stream(spark, landing, schema, files_per_trigger, delete_consumed, corrupt=True)

    def each(rows: DataFrame, batch_id: int) -> None:
        convert_batch(rows, batch_id, archive, quarantine, fmt, target_rows)

    return (
        landed.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 minutes"}))
        .start()
    )

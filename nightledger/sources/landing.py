"""Landed events: gzip JSON files in a directory, each line an event or a one-line array of events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightledger.functions.keys import event_key
from nightledger.operators.layout import time_count_chunks
from nightledger.schema import event_schema
from nightledger.sources import files

FILE_EVENTS = 40000
CORRUPT = "_corrupt"


def read_landing(
    spark: SparkSession, path: str, schema: T.StructType | None = None, corrupt: bool = False
) -> DataFrame:
    """Landed events under a fixed schema; an array in a file becomes one row per element.

    With ``corrupt``, rows have the column ``_corrupt`` as well; ``landed_events`` and ``quarantined`` part them.
    """
    reader = spark.read.schema(with_corrupt(schema) if corrupt else schema or event_schema())
    return reader.option("columnNameOfCorruptRecord", CORRUPT).json(path)


def with_corrupt(schema: T.StructType | None = None) -> T.StructType:
    """The event schema with the column that keeps the text of a record that does not parse."""
    return T.StructType([*(schema or event_schema()).fields, T.StructField(CORRUPT, T.StringType())])


def torn_lines(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """``(eventId, line)`` of landed lines that do not parse, with their whole text; the id where it could be read."""
    lines = spark.read.schema(with_corrupt(schema)).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return lines.filter(F.col(CORRUPT).isNotNull()).select("eventId", F.col(CORRUPT).alias("line"))


TORN, NO_CHANNEL = "TORN", "NO_CHANNEL"


def quarantine_reason() -> Column:
    """Why a row read ``with_corrupt`` is no event: its record does not parse, or names no channel; null for events."""
    named = F.col("eventId").isNotNull() & F.col("source").isNotNull() & F.col("eventName").isNotNull()
    return F.when(F.col(CORRUPT).isNotNull(), TORN).when(~named, NO_CHANNEL)


def landed_events(rows: DataFrame) -> DataFrame:
    """The whole events among rows read ``with_corrupt``."""
    return rows.filter(quarantine_reason().isNull()).drop(CORRUPT)


def quarantined(rows: DataFrame) -> DataFrame:
    """``(eventId, reason, line)`` of the other rows; a record that parsed but names no channel is shown as JSON."""
    event = F.to_json(F.struct(*[c for c in rows.columns if c != CORRUPT]))
    bad = rows.withColumn("reason", quarantine_reason()).filter(F.col("reason").isNotNull())
    return bad.select("eventId", "reason", F.coalesce(CORRUPT, event).alias("line"))


def read_landing_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    files_per_trigger: int = 300,
    delete_consumed: bool = False,
    corrupt: bool = False,
) -> DataFrame:
    """The same as a stream, admitting a bounded number of files per trigger.

    With ``corrupt``, rows have the column ``_corrupt`` as well; ``landed_events`` and ``quarantined`` part them.
    """
    return (
        spark.readStream.schema(with_corrupt(schema) if corrupt else schema or event_schema())
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("cleanSource", "delete" if delete_consumed else "off")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path)
    )


def write_landing(events: DataFrame, path: str, file_events: int = FILE_EVENTS) -> None:
    """Append events as gzip JSON files of bounded size. Spark's commit shows whole files only."""
    events.write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", file_events).json(path)


def write_landing_arrays(
    archive: DataFrame, path: str, file_events: int = FILE_EVENTS, duration: str = "2 seconds"
) -> None:
    """Append events as gzip files of one JSON array each: a batch of ``time_count_chunks``, in time order.

    ``archive`` has the event columns and the parsed time. An array holds at most ``file_events`` events.
    """
    event = [name for name in event_schema().fieldNames() if name in archive.columns]
    rows = archive.select("eventTimeStamp", *event)
    batches = time_count_chunks(rows, file_events, duration).groupBy("window_start", "chunk")
    member = F.struct("eventTimeStamp", "eventId", F.struct(*event).alias("event"))
    ordered = F.sort_array(F.collect_list(member))
    arrays = batches.agg(F.to_json(F.transform(ordered, lambda m: m["event"])).alias("value"))
    arrays.select("value").write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def infer_schema(spark: SparkSession, path: str, multi_line: bool = False) -> T.StructType:
    """The schema of landed JSON; ``.json()`` of it is what to keep, ``StructType.fromJson`` reloads it.

    ``multi_line`` is for files whose array or events span lines.
    """
    return spark.read.option("multiLine", multi_line).json(path).schema


def store_schema(spark: SparkSession, folder: str, schema: T.StructType) -> str:
    """Keep a schema as JSON in a folder of schemas, as its newest version; returns the version's name."""
    files.make_folder(spark, folder)
    last = files.newest(spark, folder)
    name = files.numbered(0 if last is None else int(last[:19]) + 1, 0)
    files.write_json(spark, folder, name, schema.jsonValue())
    return name


def stored_schema(spark: SparkSession, folder: str, version: str | None = None) -> T.StructType:
    """The newest schema of a folder, or the version of the given name."""
    name = version or files.newest(spark, folder)
    if name is None:
        raise FileNotFoundError(f"no schema in {folder}")
    return T.StructType.fromJson(files.read_json(spark, f"{folder}/{name}"))


#: Pairs of simple types of which values of the first fit the second.
_WHOLE = ["tinyint", "smallint", "int", "bigint"]
_WIDER = {(a, b) for i, a in enumerate(_WHOLE) for b in _WHOLE[i + 1 :]}
_WIDER |= {(a, "double") for a in ("float", "tinyint", "smallint", "int")}
ADDED, MISSING, WIDENED, NARROWED, CONFLICTING = "ADDED", "MISSING", "WIDENED", "NARROWED", "CONFLICTING"


def schema_drift(spark: SparkSession, stored: T.StructType, found: T.StructType) -> DataFrame:
    """``(path, stored, found, drift)`` of the leaves in which a found schema differs from the stored one.

    A leaf may be added or missing, have a wider or narrower number type, or one that does not fit.
    """
    before, after = dict(field_types(stored)), dict(field_types(found))

    def drift(path: str) -> str:
        pair = (before.get(path), after.get(path))
        if None in pair:
            return ADDED if pair[0] is None else MISSING
        return WIDENED if pair in _WIDER else NARROWED if pair[::-1] in _WIDER else CONFLICTING

    paths = sorted(p for p in before.keys() | after.keys() if before.get(p) != after.get(p))
    rows = [(p, before.get(p), after.get(p), drift(p)) for p in paths]
    return spark.createDataFrame(rows, "path string, stored string, found string, drift string")


def field_types(schema: T.DataType, prefix: str = "") -> list[tuple[str, str]]:
    """(path, type) of every leaf of a schema; array elements add ``[]`` to the path."""
    if isinstance(schema, T.StructType):
        return [
            row
            for field in schema.fields
            for row in field_types(field.dataType, f"{prefix}.{field.name}" if prefix else field.name)
        ]
    if isinstance(schema, T.ArrayType):
        return field_types(schema.elementType, f"{prefix}[]")
    return [(prefix, schema.simpleString())]


def decode_payloads(payloads: DataFrame, column: str, schema: T.StructType | None = None) -> DataFrame:
    """Decode JSON payloads; one that does not decode becomes a row with ``is_bad`` and empty event fields.

    A payload without id, source or event name names no channel and is bad as well.
    """
    schema = schema or event_schema()
    event = F.from_json(F.col(column), with_corrupt(schema), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    decoded = payloads.withColumn("_event", event)
    bad = F.col(f"_event.{CORRUPT}").isNotNull() | F.concat(
        "_event.eventId", "_event.source", "_event.eventName"
    ).isNull()
    decoded = decoded.withColumn("is_bad", F.coalesce(bad, F.lit(True)))
    fields = [F.when(~F.col("is_bad"), F.col(f"_event.{name}")).alias(name) for name in schema.fieldNames()]
    return decoded.select(*[c for c in payloads.columns if c != column], *fields, "is_bad")


def merge_streams(*streams: DataFrame) -> DataFrame:
    """Bag union of several publishers' events; a field one of them lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)


def with_key(events: DataFrame) -> DataFrame:
    """Add the channel key."""
    return events.withColumn("event_key", event_key(F.col("source"), F.col("eventName")))

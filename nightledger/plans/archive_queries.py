"""Queries over landed events and the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nightledger.functions.params import matching, value_at
from nightledger.functions.times import event_timestamp, micro_text
from nightledger.operators import filters, layout
from nightledger.plans import fixtures as fx
from nightledger.plans.fixtures import sql
from nightledger.plans.registry import query
from nightledger.schema import CHANNEL_COLUMNS
from nightledger.session import scratch
from nightledger.sources import archive as store
from nightledger.sources import compaction, landing


def _shown(events: DataFrame) -> DataFrame:
    """Event columns and the first value of each parameter."""
    params = F.col("paramSet")
    return events.select(
        "eventId",
        "source",
        "eventName",
        "eventTime",
        value_at(params["IntKey"], "temperature").alias("temperature"),
        value_at(params["IntKey"], "intensity").alias("intensity"),
        value_at(params["DoubleKey"], "power").alias("power"),
        value_at(params["StringKey"], "state").alias("state"),
    )


def _archived(rows: DataFrame) -> DataFrame:
    parts = ["eventUnixTimeStamp", "year", "month", "day", "hour", "minute", "second"]
    return rows.select(*_shown(rows).columns[:4], micro_text(F.col("eventTimeStamp")).alias("at"), *parts)


_STATE = """CASE WHEN is_obs = 0 THEN state END AS state"""
_SHOWN = f""""eventId", source, "eventName", "eventTime", temperature[1] AS temperature, intensity[1] AS intensity,
    power[1] AS power, {_STATE}"""
_CALENDAR = """CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS "eventUnixTimeStamp", CAST(year(ts) AS INTEGER) AS year,
    CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour,
    CAST(minute(ts) AS INTEGER) AS minute, CAST(second(ts) AS INTEGER) AS second"""
_ARCHIVED = f""""eventId", source, "eventName", "eventTime", "eventTime" AS at, {_CALENDAR}"""
_PARTITION = """CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
    CAST(day(ts) AS INTEGER) AS day, source, "eventName" """


_ID_NUMBER = """CAST('0x' || substr(md5("eventId"), 1, 8) AS BIGINT)"""


@query("json_landing_scan", sql(f"SELECT {_SHOWN} FROM bus", "bus"))
def json_landing_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one JSON array per batch of events, read as rows."""

    def build(path: str) -> None:
        landing.write_landing_arrays(fx.bus(spark, sf_dir), path, 500, "1 day")

    rows = landing.read_landing(spark, fx.built(spark, sf_dir, "arrays", build), fx.EVENT, corrupt=True)
    return _shown(landing.landed_events(rows))


_ELEMENTS = {"DoubleKey": "double", "IntKey": "bigint", "StringKey": "string"}
_INFERRED = [(name, "string") for name in ("eventId", "eventName", "eventTime", "source")] + [
    row
    for key, kind in _ELEMENTS.items()
    for row in (
        (f"paramSet.{key}[].keyName", "string"),
        (f"paramSet.{key}[].units", "string"),
        (f"paramSet.{key}[].values[]", kind),
    )
]


def landed(spark: SparkSession, sf_dir: str, name: str = "landed") -> str:
    return fx.built(spark, sf_dir, name, lambda path: landing.write_landing(fx.landed_bus(spark, sf_dir), path))


@query("infer_event_schema", f"SELECT * FROM (VALUES {fx.sql_values(_INFERRED)}) t(path, type)")
def infer_event_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inferred from the landed files by one job, stored, and read back as a conversion does."""
    folder = scratch(spark, "schemas")
    landing.store_schema(spark, folder, landing.infer_schema(spark, landed(spark, sf_dir)))
    return spark.createDataFrame(landing.field_types(landing.stored_schema(spark, folder)), "path string, type string")


@query("json_landing_sink", sql(f"SELECT {_SHOWN} FROM bus", "bus"))
def json_landing_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "landing")
    landing.write_landing(fx.landed_bus(spark, sf_dir), path, file_events=2000)
    return _shown(landing.read_landing(spark, path, fx.EVENT))


@query("archive_sink", sql(f"SELECT {_ARCHIVED} FROM bus", "bus"))
def archive_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "archive")
    store.write_archive(store.archive_rows(fx.landed_bus(spark, sf_dir)), path)
    return _archived(store.read_archive(spark, path, fx.EVENT))


@query("archive_scan", sql(f"SELECT {_SHOWN} FROM bus", "bus"))
def archive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(fx.archive(spark, sf_dir))


@query(
    "archive_compaction",
    sql(
        f"""SELECT {_PARTITION}, count(*) AS n_rows, CAST(1 AS BIGINT) AS n_files, CAST(0 AS BIGINT) AS n_unordered,
        CAST(sum({_ID_NUMBER}) AS BIGINT) AS ids FROM bus GROUP BY ALL""",
        "bus",
    ),
)
def archive_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout and event ids (as a sum of numbers made of them) of every table partition of the new generation."""
    target = scratch(spark, "compacted")
    store.compact(spark, fx.fragments(spark, sf_dir), target, fx.EVENT)
    rows = store.read_archive(spark, target, fx.EVENT)
    number = F.conv(F.substring(F.md5("eventId"), 1, 8), 16, 10).cast("bigint")
    ids = rows.groupBy(*CHANNEL_COLUMNS).agg(F.sum(number).alias("ids"))
    return store.file_layout(rows).join(ids, CHANNEL_COLUMNS)


@query("archive_live_compaction", sql(f"SELECT {_SHOWN} FROM bus", "bus"))
def archive_live_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry is appended and compacted; observe events are appended to the compacted days and read beside them."""
    root = scratch(spark, "store")
    store.write_archive(store.archive_rows(fx.telemetry(spark, sf_dir)), compaction.incoming(root), layout=False)
    compaction.compact_days(spark, root, fx.EVENT)
    store.write_archive(store.archive_rows(fx.observe(spark, sf_dir)), compaction.incoming(root), layout=False)
    return _shown(compaction.read_live(spark, root, fx.EVENT))


@query(
    "permissive_decode",
    sql(
        """SELECT event_id, event_type IN ('error', 'purchase') AS is_bad,
        CASE WHEN event_type NOT IN ('error', 'purchase') THEN source END AS source,
        CASE WHEN event_type NOT IN ('error', 'purchase') THEN "eventName" END AS "eventName",
        CASE WHEN event_type NOT IN ('error', 'purchase') THEN k END AS temperature FROM tel""",
        "tel",
    ),
)
def permissive_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events have a torn payload and purchases one without an event name."""
    rows = fx.telemetry(spark, sf_dir)
    kind = value_at(F.col("paramSet.StringKey"), "state")
    whole = F.to_json(F.struct(*fx.EVENT.fieldNames()))
    nameless = F.to_json(F.struct("eventId", "source"))
    payload = F.when(kind == "error", F.substr(whole, F.lit(1), F.length(whole) - 5)).when(
        kind == "purchase", nameless
    )
    payloads = rows.select(F.col("eventId").cast("bigint").alias("event_id"), F.coalesce(payload, whole).alias("payload"))
    decoded = landing.decode_payloads(payloads, "payload", fx.EVENT)
    temperature = value_at(F.col("paramSet.IntKey"), "temperature").alias("temperature")
    return decoded.select("event_id", "is_bad", "source", "eventName", temperature)


@query(
    "filter_event_pattern",
    sql(
        """SELECT "eventId", event_key FROM bus WHERE event_key LIKE '%.%.ObserveEvent.ExposureStart'
        OR event_key LIKE 'IRIS.%' OR event_key LIKE '%!_key!_1' ESCAPE '!'""",
        "bus",
    ),
)
def filter_event_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = ["*.*.ObserveEvent.ExposureStart", "IRIS.*", "*_key_1"]
    return filters.by_key_pattern(fx.bus(spark, sf_dir), patterns).select("eventId", "event_key")


@query(
    "partition_filter",
    sql(f"SELECT {_SHOWN} FROM bus WHERE year(ts) = 2024 AND month(ts) = 1 AND day(ts) = 19", "bus"),
)
def partition_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(filters.on_day(fx.archive(spark, sf_dir), 2024, 1, 19))


_LOW, _HIGH = "2024-01-03T07:08:39.066141Z", "2024-01-27T07:08:39Z"
_RANGE = "ts BETWEEN TIMESTAMP '2024-01-03 07:08:39.066141' AND TIMESTAMP '2024-01-27 07:08:39'"


@query("time_range_filter", sql(f"SELECT {_SHOWN} FROM bus WHERE {_RANGE}", "bus"))
def time_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(filters.in_time_range(fx.archive(spark, sf_dir), _LOW, _HIGH))


@query(
    "channel_filter",
    sql(f"""SELECT {_SHOWN} FROM bus WHERE source = 'Container.filter' AND "eventName" = 'event_key_4'""", "bus"),
)
def channel_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(filters.of_channel(fx.archive(spark, sf_dir), "Container.filter", "event_key_4"))


@query("derive_time_columns", sql(f"SELECT {_ARCHIVED} FROM bus", "bus"))
def derive_time_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _archived(store.archive_rows(fx.landed_bus(spark, sf_dir)))


@query(
    "param_element",
    sql("""SELECT "eventId", temperature[1] AS temperature, temperature[2] AS second_value, power[1] AS power,
        CAST(NULL AS INTEGER) AS absent FROM bus""", "bus"),
)
def param_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    ints, doubles = F.col("paramSet.IntKey"), F.col("paramSet.DoubleKey")
    return fx.bus(spark, sf_dir).select(
        "eventId",
        value_at(ints, "temperature").alias("temperature"),
        value_at(ints, "temperature", 1).alias("second_value"),
        value_at(doubles, "power").alias("power"),
        value_at(ints, "intensity", 5).alias("absent"),
    )


@query(
    "param_filter",
    sql("""SELECT "eventId", CASE WHEN is_obs = 0 THEN 1 ELSE NULL END AS n_matching,
        CASE WHEN is_obs = 0 THEN 'intensity' END AS key_name, intensity[1] AS value FROM bus""", "bus"),
)
def param_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.bus(spark, sf_dir).select("eventId", matching(F.col("paramSet.IntKey"), "intensity").alias("p"))
    first = F.get("p", F.lit(0))
    size = F.when(F.col("p").isNotNull(), F.size("p"))
    return rows.select(
        "eventId",
        size.alias("n_matching"),
        first["keyName"].alias("key_name"),
        F.get(first["values"], F.lit(0)).alias("value"),
    )


_SERIES = """SELECT "eventTime", temperature[1] AS temperature FROM bus
    WHERE source = 'IRIS.filter' AND "eventName" = 'event_key_1'"""


def _temperatures(spark: SparkSession, sf_dir: str, **where) -> DataFrame:
    rows = fx.archive(spark, sf_dir)
    return filters.single_event_query(rows, "IRIS.filter", "event_key_1", "IntKey", "temperature", **where)


@query("single_event_query", sql(f"{_SERIES} AND {_RANGE}", "bus"))
def single_event_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _temperatures(spark, sf_dir, low=_LOW, high=_HIGH)


@query(
    "multi_event_join",
    sql(
        f"""SELECT COALESCE(a."eventTime", b."eventTime") AS "eventTime", temperature, "exposureId"
        FROM ({_SERIES}) a FULL OUTER JOIN (SELECT "eventTime", state AS "exposureId" FROM bus
            WHERE source = 'ESW.observe' AND "eventName" = 'ObserveEvent.ExposureStart') b
        ON a."eventTime" = b."eventTime" ORDER BY 1""",
        "bus",
    ),
)
def multi_event_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperatures beside the exposures that start at the same instant."""
    starts = filters.single_event_query(
        fx.archive(spark, sf_dir), "ESW.observe", "ObserveEvent.ExposureStart", "StringKey", "exposureId"
    )
    return filters.multi_event_join(_temperatures(spark, sf_dir), starts)


@query("result_count", sql(f"SELECT count(*) AS n_rows FROM ({_SERIES})", "bus"))
def result_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.row_count(_temperatures(spark, sf_dir))


_CHUNKS = """SELECT "eventId", ts, date_trunc('day', ts) AS w,
    CAST((row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ord) - 1) // 100 AS BIGINT) AS chunk FROM bus"""


def _chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.bus(spark, sf_dir).select("eventId", "eventTimeStamp")


@query(
    "ingest_batch_stats",
    sql(
        f"""SELECT strftime(w, '%Y-%m-%dT%H:%M:%S.%fZ') AS window_start, chunk, count(*) AS n_events,
        strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%fZ') AS first_ts, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%fZ') AS last_ts
        FROM ({_CHUNKS}) GROUP BY w, chunk""",
        "bus",
    ),
)
def ingest_batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = layout.batch_stats(_chunk_rows(spark, sf_dir), 100, "1 day")
    return stats.withColumns({c: micro_text(F.col(c)) for c in ("window_start", "first_ts", "last_ts")})


@query(
    "time_count_chunks",
    sql(f"""SELECT "eventId", strftime(w, '%Y-%m-%dT%H:%M:%S.%fZ') AS window_start, chunk FROM ({_CHUNKS})""", "bus"),
)
def time_count_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = layout.time_count_chunks(_chunk_rows(spark, sf_dir), 100, "1 day")
    return chunks.select("eventId", micro_text(F.col("window_start")).alias("window_start"), "chunk")


@query("order_by_time", sql(f"SELECT {_SHOWN} FROM bus ORDER BY ord", "bus"))
def order_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(filters.ordered_by_time(fx.archive(spark, sf_dir)))


@query(
    "sort_within_partitions",
    sql(f"SELECT {_PARTITION}, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_unordered FROM bus GROUP BY ALL", "bus"),
)
def sort_within_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that stand before an earlier one of their channel after the local sort: none."""
    placed = layout.channel_layout(store.archive_rows(fx.landed_bus(spark, sf_dir)))
    placed = placed.select(*CHANNEL_COLUMNS, "eventTimeStamp", F.monotonically_increasing_id().alias("place"))
    order = Window.partitionBy(F.shiftright("place", 33), *CHANNEL_COLUMNS).orderBy("place")
    before = placed.withColumn("before", F.lag("eventTimeStamp").over(order))
    return before.groupBy(*CHANNEL_COLUMNS).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("before") > F.col("eventTimeStamp")).alias("n_unordered")
    )


@query(
    "repartition_by_channel",
    sql(f"SELECT {_PARTITION}, count(*) AS n_rows, CAST(1 AS BIGINT) AS n_writers FROM bus GROUP BY ALL", "bus"),
)
def repartition_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = layout.by_channel(store.archive_rows(fx.landed_bus(spark, sf_dir)))
    return (
        placed.withColumn("writer", F.spark_partition_id())
        .groupBy(*CHANNEL_COLUMNS)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("writer").alias("n_writers"))
    )


@query("take_n_events", sql(f"SELECT {_SHOWN} FROM bus ORDER BY ord LIMIT 500", "bus"))
def take_n_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(filters.first_events(fx.archive(spark, sf_dir), 500))


@query("merge_streams", sql(f"SELECT {_SHOWN} FROM bus", "bus"))
def merge_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two publishers' landing directories read as one."""
    first = fx.built(spark, sf_dir, "tel", lambda p: landing.write_landing(fx.telemetry(spark, sf_dir), p))
    second = fx.built(spark, sf_dir, "obs", lambda p: landing.write_landing(fx.observe(spark, sf_dir), p))
    return _shown(landing.merge_streams(*[landing.read_landing(spark, p, fx.EVENT) for p in (first, second)]))


@query(
    "event_time_to_timestamp",
    sql(
        """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL
            WHEN event_type = 'view' THEN strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.%fZ')
            ELSE "eventTime" END AS at,
        CASE WHEN event_type <> 'error' THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) END AS unix_at FROM tel""",
        "tel",
    ),
)
def event_time_to_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events carry a malformed time and views one without a fraction."""
    rows = fx.events(spark, sf_dir)
    text = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("at "), micro_text(F.col("ts"))))
        .when(F.col("event_type") == "view", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise(micro_text(F.col("ts")))
    )
    at = event_timestamp(text)
    return rows.select("event_id", micro_text(at).alias("at"), F.unix_timestamp(at).alias("unix_at"))

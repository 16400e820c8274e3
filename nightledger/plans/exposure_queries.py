"""Queries over snapshots, keyword values and headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightledger.functions.times import micro_text
from nightledger.operators import headers, keywords, mapping, quality, snapshot, state
from nightledger.operators.sizes import keep_values
from nightledger.plans import fixtures as fx
from nightledger.plans.fixtures import sql
from nightledger.plans.registry import query
from nightledger.session import scratch
from nightledger.sources import config, keyword_store, tables


def _snapshot_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "obs_event_id",
        "exposure_id",
        "obs_event_name",
        "event_key",
        "eventId",
        micro_text(F.col("eventTimeStamp")).alias("at"),
    )


SNAPSHOT_SQL = sql(
    """SELECT obs_event_id, exposure_id, obs_event_name, event_key, "eventId", "eventTime" AS at FROM snap""", "snap"
)


@query("event_snapshot", SNAPSHOT_SQL)
def event_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshot_columns(snapshot.event_snapshot(fx.stored_bus(spark, sf_dir), by_instant=True))


@query(
    "latest_per_key",
    sql(
        """SELECT event_key, arg_max("eventId", ord) AS "eventId", max("eventTime") AS at,
        arg_max(temperature[1], ord) FILTER (WHERE is_obs = 0) AS temperature FROM bus GROUP BY event_key""",
        "bus",
    ),
)
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = state.latest_per_key(fx.stored_bus(spark, sf_dir))
    temperature = F.get(F.get("paramSet.IntKey.values", F.lit(0)), F.lit(0))
    return rows.select(
        "event_key", "eventId", micro_text(F.col("eventTimeStamp")).alias("at"), temperature.alias("temperature")
    )


@query(
    "snapshot_sink",
    sql(
        """SELECT exposure_id, obs_event_name, source, "eventName" AS eventname, "eventId" AS eventid,
        "eventTime" AS at, CAST(temperature[1] AS VARCHAR) AS temperature, state FROM snap""",
        "snap",
    ),
)
def snapshot_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "snapshots")
    tables.write_snapshots(snapshot.event_snapshot(fx.stored_bus(spark, sf_dir), by_instant=True), path)
    return tables.read_snapshots(spark, path).select(
        *tables.SNAPSHOT_COLUMNS[:5],
        micro_text(F.col("eventtime")).alias("at"),
        F.get_json_object("paramset", "$.IntKey[0].values[0]").alias("temperature"),
        F.get_json_object("paramset", "$.StringKey[0].values[0]").alias("state"),
    )


KEYWORDS_SQL = sql("SELECT obs_event_id, exposure_id, obs_event_name, keyword, value FROM kv", "kv")
_KEYWORDS = ["obs_event_id", "exposure_id", "obs_event_name", "keyword", "value"]


@query("keyword_extract", KEYWORDS_SQL)
def keyword_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.extracted(spark, sf_dir).select(*_KEYWORDS)


@query("keyword_value_sink", sql("SELECT exposure_id, keyword, value FROM kv", "kv"))
def keyword_value_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batch is written twice and stored once."""
    path = scratch(spark, "keyword-values")
    values = tables.staged(fx.extracted(spark, sf_dir))
    tables.write_keyword_values(values, path, 7)
    tables.write_keyword_values(values, path, 7)
    return tables.read_keyword_values(spark, path).select(*tables.KEYWORD_COLUMNS)


_ENDED = """SELECT DISTINCT exposure_id FROM obs WHERE obs_event_name = 'ObserveEvent.ExposureEnd'"""


@query(
    "keyword_values_lookup",
    sql(f"SELECT exposure_id, keyword, value FROM kv WHERE exposure_id IN ({_ENDED})", "kv", "obs"),
)
def keyword_values_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword values of all exposures that ended."""
    ended = fx.observes(spark, sf_dir).filter(F.col("obs_event_name") == "ObserveEvent.ExposureEnd")
    values = fx.keyword_values(spark, sf_dir)
    return tables.keyword_values_for(values, ended).select(*tables.KEYWORD_COLUMNS)


@query(
    "keyword_store_lookup",
    sql(f"SELECT exposure_id, keyword, value FROM kv WHERE exposure_id IN ({_ENDED})", "kv", "obs"),
)
def keyword_store_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a store of two batches, values of exposures that start and all others; the first is folded."""
    root = scratch(spark, "keyword-store")
    values = fx.keyword_values(spark, sf_dir).drop("batch_id")
    starts = F.col("obs_event_name").eqNullSafe("ObserveEvent.ExposureStart")
    keyword_store.append(values.filter(starts), root, 0)
    keyword_store.append(values.filter(~starts), root, 1)
    keyword_store.fold(spark, root)
    ended = fx.observes(spark, sf_dir).filter(F.col("obs_event_name") == "ObserveEvent.ExposureEnd")
    return keyword_store.lookup_for(spark, root, ended).select(*tables.KEYWORD_COLUMNS)


@query("keyword_last_wins", sql("SELECT * FROM kv_last", "kv_last"))
def keyword_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.keyword_last_wins(fx.keyword_values(spark, sf_dir))


@query(
    "keyword_map",
    sql(
        """SELECT exposure_id, string_agg(keyword || '=' || value, ';' ORDER BY keyword) AS entries,
        count(*) AS n_keywords FROM kv_last GROUP BY exposure_id""",
        "kv_last",
    ),
)
def keyword_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = state.keyword_map(state.keyword_last_wins(fx.keyword_values(spark, sf_dir)))
    entries = F.transform(F.map_entries("keywords"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return maps.select(
        "exposure_id",
        F.array_join(entries, ";").alias("entries"),
        F.size("keywords").cast("bigint").alias("n_keywords"),
    )


@query(
    "mapping_for_observe",
    sql(
        """SELECT o.obs_event_id, o.obs_event_name, o.exposure_id, r.subsystem, r.keyword, r.kind FROM obs o
        JOIN rules r ON r.subsystem = o.subsystem AND r.obs_event_name = o.obs_event_name""",
        "obs",
        "rules",
    ),
)
def mapping_for_observe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mapping.mapping_for(fx.mappings(spark), fx.observes(spark, sf_dir))
    return rows.select("obs_event_id", "obs_event_name", "exposure_id", "subsystem", "keyword", "kind")


@query(
    "constant_keyword",
    sql(
        """SELECT o.obs_event_id, o.exposure_id, o.obs_event_name, r.keyword, r.value FROM obs o
        JOIN rules r ON r.subsystem = o.subsystem AND r.obs_event_name = o.obs_event_name WHERE r.kind = 'constant'""",
        "obs",
        "rules",
    ),
)
def constant_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.constant_keywords(fx.observes(spark, sf_dir), fx.mappings(spark)).select(*_KEYWORDS)


_CARD = """rpad(h.keyword, 8, ' ') || '= ''' || replace(v.value, '''', '''''')
    || repeat(' ', greatest(0, 8 - length(replace(v.value, '''', '''''')))) || ''''"""
_FULL_CARD = f"rpad({_CARD}, 80, ' ')"


def _last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.keyword_last_wins(fx.keyword_values(spark, sf_dir))


@query(
    "fits_header",
    sql(
        f"""SELECT x.exposure_id, COALESCE(string_agg({_FULL_CARD}, chr(10) ORDER BY h.pos)
            FILTER (WHERE v.value IS NOT NULL), '') AS header
        FROM (SELECT DISTINCT exposure_id, subsystem FROM obs) x
        LEFT JOIN headers h ON h.subsystem = x.subsystem
        LEFT JOIN kv_last v ON v.exposure_id = x.exposure_id AND v.keyword = h.keyword GROUP BY x.exposure_id""",
        "obs",
        "kv_last",
        "headers",
    ),
)
def fits_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers.fits_headers(fx.exposures(spark, sf_dir), fx.header_lists(spark), _last(spark, sf_dir))


@query(
    "header_subset",
    sql(
        f"""SELECT x.exposure_id, COALESCE(string_agg({_FULL_CARD}, chr(10) ORDER BY h.pos)
            FILTER (WHERE v.value IS NOT NULL), '') AS header
        FROM (SELECT DISTINCT exposure_id FROM obs UNION SELECT DISTINCT lower(exposure_id) FROM obs) x
        CROSS JOIN (VALUES (0, 'STATE'), (1, 'CONST1'), (2, 'UNMAPPED'), (4, 'INTENS')) h(pos, keyword)
        LEFT JOIN kv_last v ON v.exposure_id = x.exposure_id AND v.keyword = h.keyword GROUP BY x.exposure_id""",
        "obs",
        "kv_last",
    ),
)
def header_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every exposure is asked for four keywords, one of them twice; unknown exposure ids are asked for too."""
    known = fx.exposures(spark, sf_dir)
    asked = known.unionByName(known.select(F.lower("exposure_id").alias("exposure_id")))
    requests = asked.withColumn("keywords", F.lit("STATE,CONST1,UNMAPPED,STATE,INTENS"))
    return headers.header_subset(requests, _last(spark, sf_dir))


@query(
    "header_list_source",
    sql(
        """SELECT DISTINCT o.exposure_id, h.pos, h.keyword FROM obs o LEFT JOIN headers h ON h.subsystem = o.subsystem""",
        "obs",
        "headers",
    ),
)
def header_list_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header lists stored as JSON entries, given to every exposure."""

    def build(path: str) -> None:
        spark.createDataFrame(
            [(s, k) for s, _, k in fx.OWN_HEADERS], "subsystem string, keywords array<string>"
        ).write.json(path)

    lists = config.read_header_lists(spark, fx.built(spark, sf_dir, "header-lists", build))
    return headers.exposure_keywords(fx.exposures(spark, sf_dir), lists)


def _full_lists(spark: SparkSession) -> DataFrame:
    own = spark.createDataFrame(fx.OWN_HEADERS, "subsystem string, group string, keywords array<string>")
    shared = spark.createDataFrame(fx.SHARED_HEADERS, "group string, keywords array<string>")
    return mapping.concat_header_lists(own, shared)


@query(
    "header_list_concat",
    sql(
        """SELECT DISTINCT o.exposure_id, h.pos, h.keyword FROM obs o
        JOIN full_headers h ON h.subsystem = o.subsystem""",
        "obs",
        "full_headers",
    ),
)
def header_list_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group's list and the subsystem's own, for every exposure that has one."""
    rows = headers.exposure_keywords(fx.exposures(spark, sf_dir), _full_lists(spark))
    return rows.filter(F.col("keyword").isNotNull())


@query(
    "ordered_header_list",
    sql(
        """SELECT exposure_id, string_agg(keyword, ',' ORDER BY pos) AS keywords FROM (
        SELECT DISTINCT o.exposure_id, h.pos, h.keyword FROM obs o JOIN full_headers h ON h.subsystem = o.subsystem)
        GROUP BY exposure_id""",
        "obs",
        "full_headers",
    ),
)
def ordered_header_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers.ordered_header_list(header_list_concat(spark, sf_dir), by="exposure_id")


@query(
    "observe_name_source",
    sql(
        """SELECT "eventName" AS event_name, count(*) AS n_events FROM bus
        WHERE "eventName" IN ('ObserveEvent.ExposureStart', 'ObserveEvent.ExposureEnd') GROUP BY 1""",
        "bus",
    ),
)
def observe_name_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events each trigger name selects."""
    names = config.observe_names(spark, ["ObserveEvent.ExposureStart", "ObserveEvent.ExposureEnd"] * 2)
    rows = fx.bus(spark, sf_dir).select(F.col("eventName").alias("event_name"))
    return rows.join(names, "event_name", "left_semi").groupBy("event_name").agg(F.count(F.lit(1)).alias("n_events"))


@query("observe_exposure_id", sql("SELECT obs_event_id, obs_event_name, exposure_id FROM obs", "obs"))
def observe_exposure_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.observes(spark, sf_dir).select("obs_event_id", "obs_event_name", "exposure_id")


@query(
    "paramset_json",
    sql(
        """SELECT "eventId", CAST(temperature[1] AS VARCHAR) AS temperature,
        CAST(temperature[2] AS VARCHAR) AS second_value, CAST(power[1] AS VARCHAR) AS power, state,
        CASE WHEN is_obs = 0 THEN 'state' ELSE 'exposureId' END AS key_name FROM bus""",
        "bus",
    ),
)
def paramset_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.bus(spark, sf_dir).select("eventId", F.to_json("paramSet").alias("j"))
    paths = {
        "temperature": "$.IntKey[0].values[0]",
        "second_value": "$.IntKey[0].values[1]",
        "power": "$.DoubleKey[0].values[0]",
        "state": "$.StringKey[0].values[0]",
        "key_name": "$.StringKey[0].keyName",
    }
    return rows.select("eventId", *[F.get_json_object("j", path).alias(name) for name, path in paths.items()])


@query(
    "params_long",
    sql(
        """SELECT "eventId", 'IntKey' AS type, 'temperature' AS key_name, 'NoUnits' AS units,
            CAST(temperature[1] AS VARCHAR) || ',' || CAST(temperature[2] AS VARCHAR) AS shown FROM bus WHERE is_obs = 0
        UNION ALL SELECT "eventId", 'IntKey', 'intensity', 'NoUnits', CAST(intensity[1] AS VARCHAR) FROM bus
            WHERE is_obs = 0
        UNION ALL SELECT "eventId", 'DoubleKey', 'power', 'NoUnits', CAST(power[1] AS VARCHAR) FROM bus WHERE is_obs = 0
        UNION ALL SELECT "eventId", 'StringKey', CASE WHEN is_obs = 0 THEN 'state' ELSE 'exposureId' END, 'NoUnits',
            state FROM bus""",
        "bus",
    ),
)
def params_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keywords.params_long(fx.bus(spark, sf_dir).select("eventId", "paramSet"))
    return rows.select("eventId", "type", "key_name", "units", F.array_join("values", ",").alias("shown"))


@query(
    "keyword_rejects",
    sql("""SELECT obs_event_id, exposure_id, obs_event_name, keyword, reason FROM outcomes
        WHERE reason IS NOT NULL""", "outcomes"),
)
def keyword_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keywords.keyword_rejects(
        fx.observes(spark, sf_dir), fx.mapped_snapshot(spark, sf_dir), fx.mappings(spark)
    )
    return rows.select("obs_event_id", "exposure_id", "obs_event_name", "keyword", "reason")


@query(
    "empty_result_check",
    sql(
        """SELECT obs_event_id, exposure_id, obs_event_name, 'SNAPSHOT' AS missing FROM obs
        WHERE obs_event_id NOT IN (SELECT obs_event_id FROM snap
            WHERE event_key IN (SELECT event_key FROM rules WHERE event_key IS NOT NULL))
        UNION ALL SELECT obs_event_id, exposure_id, obs_event_name, 'KEYWORDS' FROM obs
        WHERE obs_event_id NOT IN (SELECT obs_event_id FROM kv)""",
        "obs",
        "snap",
        "rules",
        "kv",
    ),
)
def empty_result_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observe events before any mapped channel has sent, and those of a subsystem without mappings."""
    mapped = keep_values(fx.bus(spark, sf_dir), "event_key", keywords.mapped_keys(fx.mappings(spark)))
    return quality.empty_results(fx.observes(spark, sf_dir), mapped, fx.keyword_values(spark, sf_dir))

"""Queries that put the Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightledger.functions import cards, formats, keys, params, times
from nightledger.operators import quality
from nightledger.plans import fixtures as fx
from nightledger.plans.fixtures import sql
from nightledger.plans.registry import query
from nightledger.schema import COORD_TYPE

# Exposure ids of every form, by event type and user: well-formed in either case, too short, too long, trailing dashes,
# unknown subsystem, empty and missing.
_IDS = """SELECT event_id, CASE
    WHEN event_type = 'view' AND user_id % 2 = 0 THEN '2020A-001-123-IRIS-IMG-SCI0-' || CAST(event_id AS VARCHAR)
    WHEN event_type = 'view' THEN '2020A-001-123-wfos-IMG-SCI0-' || CAST(event_id AS VARCHAR)
    WHEN event_type = 'click' AND user_id % 2 = 0 THEN '2020A-001-123-IRIS-IMG-' || CAST(event_id AS VARCHAR)
    WHEN event_type = 'click' THEN '2020A-001-123-IRIS-IMG-SCI0-X-' || CAST(event_id AS VARCHAR)
    WHEN event_type = 'error' AND user_id % 2 = 0 THEN '2020A-001-123-ESW-IMG-SCI0-' || CAST(event_id AS VARCHAR) || '-'
    WHEN event_type = 'error' THEN '2020A-001-123-Container-IMG-SCI0-' || CAST(event_id AS VARCHAR) || '---'
    WHEN event_type = 'signup' THEN '2020A-001-123-NONE-IMG-SCI0-' || CAST(event_id AS VARCHAR)
    WHEN user_id % 2 = 0 THEN '' END AS exposure_id FROM events"""
_PARSED = f"""SELECT *, CASE WHEN len(parts) = 7 AND upper(parts[4]) IN ('IRIS', 'WFOS', 'ESW', 'CONTAINER')
        THEN upper(parts[4]) END AS subsystem,
    CASE WHEN exposure_id IS NULL THEN 'NO_EXPOSURE_ID' WHEN len(parts) <> 7 THEN 'INVALID_FORMAT'
        WHEN upper(parts[4]) NOT IN ('IRIS', 'WFOS', 'ESW', 'CONTAINER') THEN 'UNKNOWN_SUBSYSTEM' END AS reason
    FROM (SELECT *, string_split(regexp_replace(exposure_id, '-+$', ''), '-') AS parts FROM ({_IDS}))"""


def _exposure_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id").cast("string")
    kind, even = F.col("event_type"), F.col("user_id") % 2 == 0

    def form(prefix: str, suffix: str = "") -> Column:
        return F.concat(F.lit(prefix), event, F.lit(suffix))

    exposure = (
        F.when((kind == "view") & even, form("2020A-001-123-IRIS-IMG-SCI0-"))
        .when(kind == "view", form("2020A-001-123-wfos-IMG-SCI0-"))
        .when((kind == "click") & even, form("2020A-001-123-IRIS-IMG-"))
        .when(kind == "click", form("2020A-001-123-IRIS-IMG-SCI0-X-"))
        .when((kind == "error") & even, form("2020A-001-123-ESW-IMG-SCI0-", "-"))
        .when(kind == "error", form("2020A-001-123-Container-IMG-SCI0-", "---"))
        .when(kind == "signup", form("2020A-001-123-NONE-IMG-SCI0-"))
        .when(even, F.lit(""))
    )
    return fx.table(spark, sf_dir, "events").select("event_id", exposure.alias("exposure_id"))


@query("exposure_subsystem", f"SELECT event_id, exposure_id, subsystem, reason FROM ({_PARSED})")
def exposure_subsystem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.with_subsystem(_exposure_ids(spark, sf_dir), fx.subsystems(spark))
    return rows.select("event_id", "exposure_id", "subsystem", "reason")


@query(
    "exposure_id_rejects",
    f"""SELECT event_id, exposure_id, reason, CASE reason WHEN 'NO_EXPOSURE_ID' THEN 'Observe event carries no exposure id'
        WHEN 'INVALID_FORMAT' THEN 'Invalid format for exposure id ' || exposure_id
        ELSE 'Invalid subsystem in exposure id ' || exposure_id END AS message
    FROM ({_PARSED}) WHERE reason IS NOT NULL""",
)
def exposure_id_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.exposure_id_rejects(_exposure_ids(spark, sf_dir), fx.subsystems(spark))
    return rows.select("event_id", "exposure_id", "reason", "message")


@query(
    "event_key",
    sql(
        """SELECT event_id, upper(split_part(source, '.', 1)) || '.filter.' || "eventName" AS from_event,
        'ESW.filter.event_key_' || CAST(k AS VARCHAR) AS from_config FROM tel""",
        "tel",
    ),
)
def event_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    configured = F.concat(F.lit("esw.filter.event_key_"), F.get("paramSet.IntKey.values", F.lit(0))[0].cast("string"))
    return fx.telemetry(spark, sf_dir).select(
        F.col("eventId").cast("bigint").alias("event_id"),
        keys.event_key(F.col("source"), F.col("eventName")).alias("from_event"),
        keys.normal_key(configured).alias("from_config"),
    )


@query(
    "param_path_parse",
    sql(
        """SELECT layer, param_key, CASE WHEN regexp_matches(param_key, '^.*\\[\\d+\\]$')
            THEN regexp_extract(param_key, '^(.*)\\[(\\d+)\\]$', 1) ELSE param_key END AS key_name,
        CASE WHEN regexp_matches(param_key, '^.*\\[\\d+\\]$')
            THEN CAST(regexp_extract(param_key, '^(.*)\\[(\\d+)\\]$', 2) AS INTEGER)
            WHEN param_key IS NOT NULL THEN 0 END AS key_index FROM order_layers""",
        "order_layers",
    ),
)
def param_path_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("param_key")
    return fx.order_layers(spark, sf_dir).select(
        "layer", "param_key", params.path_name(path).alias("key_name"), params.path_index(path).alias("key_index")
    )


@query(
    "blank_key_guard",
    sql(
        """SELECT layer, param_key, param_key IS NOT NULL AND length(trim(param_key)) > 0 AS has_name
        FROM order_layers""",
        "order_layers",
    ),
)
def blank_key_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.order_layers(spark, sf_dir)
    return rows.select("layer", "param_key", params.has_name(F.col("param_key")).alias("has_name"))


@query(
    "param_value_at",
    sql(
        """SELECT event_id, CASE WHEN i <= 1 THEN [k, k + 10][i + 1] END AS value,
        CASE WHEN i > 1 THEN 'INDEX_OUT_OF_RANGE' END AS reason
        FROM (SELECT *, CAST(user_id % 4 AS INTEGER) AS i FROM tel)""",
        "tel",
    ),
)
def param_value_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The temperature at an index that differs from event to event, some past the end."""
    rows = fx.events(spark, sf_dir).withColumn("i", (F.col("user_id") % 4).cast("int"))
    ints = F.array(F.struct(F.lit("temperature").alias("keyName"), F.array("k", F.col("k") + 10).alias("values")))
    value = params.value_at(ints, "temperature", F.col("i"))
    return rows.select(
        "event_id", value.alias("value"), F.when(value.isNull(), params.INDEX_OUT_OF_RANGE).alias("reason")
    )


@query(
    "fmt_double",
    """SELECT event_id, CAST(value AS VARCHAR) AS default_text, printf('%.3f', round(CAST(value AS DECIMAL(18, 6)) / 7, 3))
        AS custom_text FROM events""",
)
def fmt_double(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "events")
    return rows.select(
        "event_id",
        formats.double_formats(F.col("value"))[formats.DEFAULT].alias("default_text"),
        formats.double_formats(F.col("value") / 7)["custom"].alias("custom_text"),
    )


_CUT = """CASE event_type WHEN 'view' THEN date_trunc('second', ts) WHEN 'click' THEN date_trunc('milliseconds', ts)
    ELSE ts END"""


@query(
    "fmt_utc_time",
    f"""SELECT event_id, strftime(cut, '%Y-%m-%dT%H:%M:%S.%fZ') AS default_text, strftime(cut, '%Y-%m-%dT%H:%M:%S') ||
        CASE WHEN epoch_us(cut) % 1000000 = 0 THEN '' WHEN epoch_us(cut) % 1000 = 0 THEN strftime(cut, '.%g')
        ELSE strftime(cut, '.%f') END || 'Z' AS iso_text FROM (SELECT event_id, {_CUT} AS cut FROM events)""",
)
def fmt_utc_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times with no, three and six fraction digits."""
    cut = (
        F.when(F.col("event_type") == "view", F.date_trunc("second", "ts"))
        .when(F.col("event_type") == "click", F.date_trunc("millisecond", "ts"))
        .otherwise(F.col("ts"))
    )
    texts = formats.utc_time_formats(times.micro_text(cut))
    return fx.events(spark, sf_dir).select(
        "event_id", texts[formats.DEFAULT].alias("default_text"), texts["iso"].alias("iso_text")
    )


def _coord(kind: Column | str, ra: Column, dec: Column, az: Column, alt: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    parts = {"kind": kind, "tag": F.lit("BASE"), "ra": ra, "dec": dec, "az": az, "alt": alt}
    return F.struct(*[parts[f.name].cast(f.dataType).alias(f.name) for f in COORD_TYPE.fields])



@query(
    "fmt_altaz",
    """SELECT event_id, CAST(radians(value + 1) AS VARCHAR) AS az, CAST(radians((value + 1) / 6) AS VARCHAR) AS alt,
        printf('%.3f', value + 1) AS az_degrees, printf('%.3f', (value + 1) / 6) AS alt_degrees FROM events""",
)
def fmt_altaz(spark: SparkSession, sf_dir: str) -> DataFrame:
    azimuth = F.col("value") + 1
    texts = formats.coord_formats(_coord("AltAzCoord", F.lit(None), F.lit(None), azimuth, azimuth / 6))
    return fx.table(spark, sf_dir, "events").select(
        "event_id",
        texts["az"].alias("az"),
        texts["alt"].alias("alt"),
        texts["azD"].alias("az_degrees"),
        texts["altD"].alias("alt_degrees"),
    )


@query(
    "fmt_eqcoord",
    """SELECT event_id, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS ra,
        CAST(radians(-(value + 1) / 6) AS VARCHAR) AS dec
    FROM (SELECT event_id, value, CAST(round(value / 7 / 15 * 3600 * 1000) AS BIGINT) % 86400000 AS ms FROM events)""",
)
def fmt_eqcoord(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    texts = formats.coord_formats(_coord("EqCoord", value / 7, -(value + 1) / 6, F.lit(None), F.lit(None)))
    return fx.table(spark, sf_dir, "events").select("event_id", texts["ra"].alias("ra"), texts["dec"].alias("dec"))


@query(
    "fmt_default",
    sql(
        """SELECT event_id, CAST(k AS VARCHAR) AS int_text, CAST(value AS VARCHAR) AS double_text,
        CASE WHEN k > 50 THEN 'true' ELSE 'false' END AS boolean_text, event_type AS string_text,
        '[' || CAST(k AS VARCHAR) || ',' || CAST(k + 10 AS VARCHAR) || ']' AS array_text,
        '[[' || CAST(k AS VARCHAR) || '],[' || CAST(k + 10 AS VARCHAR) || ']]' AS matrix_text FROM tel""",
        "tel",
    ),
)
def fmt_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    ints, matrix = T.ArrayType(T.IntegerType()), T.ArrayType(T.ArrayType(T.IntegerType()))
    return fx.events(spark, sf_dir).select(
        "event_id",
        formats.plain_text(k, T.IntegerType()).alias("int_text"),
        formats.plain_text(F.col("value"), T.DoubleType()).alias("double_text"),
        formats.plain_text(k > 50, T.BooleanType()).alias("boolean_text"),
        formats.plain_text(F.col("event_type"), T.StringType()).alias("string_text"),
        formats.plain_text(F.array(k, k + 10), ints).alias("array_text"),
        formats.plain_text(F.array(F.array(k), F.array(k + 10)), matrix).alias("matrix_text"),
    )


@query(
    "attribute_select",
    sql(
        """SELECT event_id, attribute, CASE WHEN attribute IS NULL THEN CAST(value AS VARCHAR)
            WHEN attribute = 'custom' THEN printf('%.3f', value) END AS double_text,
        CASE WHEN attribute IS NULL THEN "eventTime"
            WHEN attribute = 'iso' THEN regexp_replace("eventTime", '000Z$', 'Z') END AS time_text,
        CASE WHEN attribute IS NULL THEN CAST(k AS VARCHAR) END AS int_text,
        CASE WHEN attribute = 'azD' THEN printf('%.3f', value) END AS coord_text
        FROM (SELECT *, ([NULL, 'custom', 'iso', 'azD'])[user_id % 4 + 1] AS attribute FROM tel)""",
        "tel",
    ),
)
def attribute_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four kinds of value under an attribute that differs from event to event; null where it is unsupported."""
    attributes = F.array(F.lit(None), F.lit("custom"), F.lit("iso"), F.lit("azD"))
    rows = fx.events(spark, sf_dir).withColumn("attribute", F.get(attributes, (F.col("user_id") % 4).cast("int")))
    none = F.lit(None)
    coord = _coord("AltAzCoord", none, none, F.col("value"), F.col("value"))
    values = {
        "double_text": ("DoubleKey", F.col("value"), T.DoubleType()),
        "time_text": ("UTCTimeKey", times.micro_text(F.col("ts")), T.StringType()),
        "int_text": ("IntKey", F.col("k"), T.IntegerType()),
        "coord_text": ("CoordKey", coord, COORD_TYPE),
    }
    return rows.select(
        "event_id",
        "attribute",
        *[
            formats.choose_format(formats.formats_of(*value), F.col("attribute")).alias(name)
            for name, value in values.items()
        ],
    )


_CARD_ROWS = """SELECT event_id, CASE event_type WHEN 'signup' THEN 'LONGKEYWORD' ELSE upper(event_type) END AS keyword,
    CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'click' THEN 'it''s ' || repeat('x', k)
        ELSE repeat('y', k) END AS value FROM tel"""


@query(
    "fits_card",
    sql(
        f"""SELECT event_id, keyword, reason, CASE WHEN reason IS NULL THEN rpad(rpad(keyword, 8, ' ') || '= ''' || q
            || repeat(' ', greatest(0, 8 - length(q))) || '''', 80, ' ') END AS card
        FROM (SELECT *, CASE WHEN length(keyword) > 8 THEN 'KEYWORD_TOO_LONG' WHEN length(q) > 68 THEN 'VALUE_TOO_LONG'
            WHEN value IS NULL THEN 'MISSING' END AS reason
            FROM (SELECT *, replace(value, '''', '''''') AS q FROM ({_CARD_ROWS})))""",
        "tel",
    ),
)
def fits_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of every length up to and past what a card holds, with apostrophes, missing, and a keyword too long."""
    kind = F.col("event_type")
    keyword = F.when(kind == "signup", "LONGKEYWORD").otherwise(F.upper(kind))
    value = F.when(kind == "click", F.concat(F.lit("it's "), F.repeat(F.lit("x"), F.col("k")))).when(
        kind != "error", F.repeat(F.lit("y"), F.col("k"))
    )
    rows = fx.events(spark, sf_dir).select("event_id", keyword.alias("keyword"), value.alias("value"))
    pair = F.col("keyword"), F.col("value")
    return rows.select(
        "event_id", "keyword", cards.card_reason(*pair).alias("reason"), cards.fits_card(*pair).alias("card")
    )


@query(
    "row_constraints",
    sql(
        """SELECT event_id, 'exposure_id' AS column_name, 'NULL' AS problem FROM tel WHERE event_type = 'error'
        UNION ALL SELECT event_id, 'value', 'TOO_LONG' FROM tel WHERE k > 50
        UNION ALL SELECT event_id, 'keyword', 'TOO_LONG' FROM tel WHERE event_type = 'purchase' AND k > 42
        UNION ALL SELECT event_id, 'eventtime', 'NULL' FROM tel WHERE event_type = 'view'""",
        "tel",
    ),
)
def row_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with missing ids and times and with texts of up to a hundred characters."""
    kind = F.col("event_type")
    rows = fx.events(spark, sf_dir).select(
        "event_id",
        F.when(kind != "error", F.lit("2020A-001-123-IRIS-IMG-SCI0-0001")).alias("exposure_id"),
        F.when(kind == "purchase", F.concat(kind, F.repeat(F.lit("K"), F.col("k")))).otherwise(kind).alias("keyword"),
        F.repeat(F.lit("v"), F.col("k")).alias("value"),
        F.when(kind != "view", F.col("ts")).alias("eventtime"),
    )
    return quality.row_constraints(rows, ["event_id"], ["exposure_id", "keyword", "value"], ["eventtime"])

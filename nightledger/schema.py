"""Schemas of events, parameters and the exposure tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Parameter type keys and the Spark type of one value.
SCALAR_TYPES = {
    "BooleanKey": T.BooleanType(),
    "ByteKey": T.ByteType(),
    "CharKey": T.StringType(),
    "ShortKey": T.ShortType(),
    "LongKey": T.LongType(),
    "IntKey": T.IntegerType(),
    "FloatKey": T.FloatType(),
    "DoubleKey": T.DoubleType(),
    "UTCTimeKey": T.StringType(),
    "TAITimeKey": T.StringType(),
    "ChoiceKey": T.StringType(),
    "StringKey": T.StringType(),
}
NUMERIC_TYPES = ("Byte", "Short", "Long", "Int", "Float", "Double")
# Angles are degrees. ``kind`` is one of EqCoord, SolarSystemCoord, MinorPlanetCoord, CometCoord, AltAzCoord.
COORD_TYPE = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("ra", T.DoubleType()),
        T.StructField("dec", T.DoubleType()),
        T.StructField("az", T.DoubleType()),
        T.StructField("alt", T.DoubleType()),
    ]
)


def parameter_types() -> dict[str, T.DataType]:
    """Every parameter type key with the type of one value; arrays and matrices follow the scalar kind."""
    types = dict(SCALAR_TYPES)
    for kind in NUMERIC_TYPES:
        types[f"{kind}ArrayKey"] = T.ArrayType(SCALAR_TYPES[f"{kind}Key"])
    for kind in NUMERIC_TYPES:
        types[f"{kind}MatrixKey"] = T.ArrayType(T.ArrayType(SCALAR_TYPES[f"{kind}Key"]))
    types["CoordKey"] = COORD_TYPE
    return types


def param_set(types: list[str] | None = None) -> T.StructType:
    """Parameters grouped by type key; ``types`` narrows the struct to the kinds a deployment uses."""
    known = parameter_types()
    return T.StructType(
        [
            T.StructField(
                key,
                T.ArrayType(
                    T.StructType(
                        [
                            T.StructField("keyName", T.StringType()),
                            T.StructField("units", T.StringType()),
                            T.StructField("values", T.ArrayType(known[key])),
                        ]
                    )
                ),
            )
            for key in (types or list(known))
        ]
    )


def event_schema(types: list[str] | None = None) -> T.StructType:
    """One telemetry event as it is landed."""
    return T.StructType(
        [
            T.StructField("eventId", T.StringType()),
            T.StructField("source", T.StringType()),
            T.StructField("eventName", T.StringType()),
            T.StructField("eventTime", T.StringType()),
            T.StructField("paramSet", param_set(types)),
        ]
    )


def archive_schema(event: T.StructType) -> T.StructType:
    """The archive adds the parsed time and its calendar parts to the event."""
    derived = T.StructType(
        [
            T.StructField("eventTimeStamp", T.TimestampType()),
            T.StructField("eventUnixTimeStamp", T.LongType()),
            T.StructField("year", T.IntegerType()),
            T.StructField("month", T.IntegerType()),
            T.StructField("day", T.IntegerType()),
            T.StructField("hour", T.IntegerType()),
            T.StructField("minute", T.IntegerType()),
            T.StructField("second", T.IntegerType()),
        ]
    )
    return T.StructType(event.fields + derived.fields)


# The archive's partition columns, outermost first.
CHANNEL_COLUMNS = ["year", "month", "day", "source", "eventName"]

# Observe events that trigger a snapshot. Constant keywords belong to the first.
EXPOSURE_START = "ObserveEvent.ExposureStart"
EXPOSURE_END = "ObserveEvent.ExposureEnd"
OBSERVE_EVENTS = [EXPOSURE_START, EXPOSURE_END]

# Subsystem names in use.
SUBSYSTEMS = ["IRIS", "WFOS", "ESW", "Container"]

MAPPING_SCHEMA = (
    "subsystem string, layer bigint, keyword string, value string, "
    "obs_event_name string, event_key string, param_key string, attribute string"
)
HEADER_SCHEMA = "subsystem string, pos int, keyword string"

# The tables' text columns hold at most this many characters.
TEXT_LIMIT = 50

"""Text of parameter values as header keywords show them.

Each function returns the formats of one kind of value by attribute name. ``default`` is used when a mapping names
no attribute; a kind without ``default`` (coordinates) needs one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightledger.functions.times import event_timestamp, iso_instant

DEFAULT = "default"


def plain_text(value: Column, kind: T.DataType) -> Column:
    """Text of any value; arrays, matrices and structs as JSON."""
    if isinstance(kind, (T.ArrayType, T.StructType)):
        return F.to_json(value)
    return value.cast("string")


def three_decimals(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%.3f", value))


def right_ascension(degrees: Column) -> Column:
    """``HH:MM:SS.mmm`` of an angle in degrees, rounded once in milliseconds of time so 60 never shows."""
    day = 24 * 3600 * 1000
    millis = F.pmod(F.round(degrees / 15 * 3600 * 1000).cast("bigint"), F.lit(day))
    text = F.format_string(
        "%02d:%02d:%02d.%03d",
        F.floor(millis / 3600000),
        F.floor(millis / 60000) % 60,
        F.floor(millis / 1000) % 60,
        millis % 1000,
    )
    return F.when(degrees.isNotNull(), text)


def double_formats(value: Column) -> dict[str, Column]:
    return {DEFAULT: value.cast("string"), "custom": three_decimals(value)}


def utc_time_formats(value: Column) -> dict[str, Column]:
    return {DEFAULT: value, "iso": iso_instant(event_timestamp(value))}


def coord_formats(value: Column) -> dict[str, Column]:
    """Equatorial and alt-az coordinates; an attribute of the other kind is unsupported."""
    eq = value["kind"] == "EqCoord"
    altaz = value["kind"] == "AltAzCoord"
    other = ~F.coalesce(eq | altaz, F.lit(False))
    return {
        "ra": F.when(eq, right_ascension(value["ra"])),
        "dec": F.when(eq, F.radians(value["dec"]).cast("string")),
        "az": F.when(altaz, F.radians(value["az"]).cast("string")),
        "alt": F.when(altaz, F.radians(value["alt"]).cast("string")),
        "azD": F.when(altaz, three_decimals(value["az"])),
        "altD": F.when(altaz, three_decimals(value["alt"])),
        DEFAULT: F.when(other, F.to_json(value)),
    }


def formats_of(type_key: str, value: Column, kind: T.DataType) -> dict[str, Column]:
    """The formats a value of the given parameter type supports."""
    if type_key == "DoubleKey":
        return double_formats(value)
    if type_key == "UTCTimeKey":
        return utc_time_formats(value)
    if type_key == "CoordKey":
        return coord_formats(value)
    return {DEFAULT: plain_text(value, kind)}


def choose_format(formats: dict[str, Column], attribute: Column) -> Column:
    """The format the attribute names (``default`` if null); null if there is none."""
    wanted = F.coalesce(attribute, F.lit(DEFAULT))
    chosen = None
    for name, text in formats.items():
        chosen = F.when(wanted == name, text) if chosen is None else chosen.when(wanted == name, text)
    return chosen

"""Event times. The session time zone must be UTC (see ``session.prepare``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICRO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def event_timestamp(event_time: Column) -> Column:
    """The instant an ISO text names, to the microsecond; malformed text gives null."""
    return F.try_to_timestamp(event_time)


def calendar_columns(ts: Column) -> dict[str, Column]:
    """Year to second, all of the same parsed instant."""
    return {
        "year": F.year(ts),
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "hour": F.hour(ts),
        "minute": F.minute(ts),
        "second": F.second(ts),
    }


def micro_text(ts: Column) -> Column:
    """ISO text with six fraction digits, whatever the value."""
    return F.date_format(ts, MICRO_FORMAT)


def iso_instant(ts: Column) -> Column:
    """ISO instant with zero, three or six fraction digits, the fewest that lose nothing."""
    return F.regexp_replace(micro_text(ts), r"(?:\.000000|(\.\d{3})000)Z$", "$1Z")

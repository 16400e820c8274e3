"""Last-wins aggregates. All of them combine on the map side, so hot keys shrink before they move."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT_COLUMNS = ["source", "eventName", "eventId", "eventTimeStamp", "paramSet"]


def latest_per_key(events: DataFrame) -> DataFrame:
    """The last event of every channel, by time and then id."""
    last = F.max_by(F.struct(*EVENT_COLUMNS), F.struct("eventTimeStamp", "eventId"))
    return events.groupBy("event_key").agg(last.alias("e")).select("event_key", "e.*")


def keyword_last_wins(values: DataFrame) -> DataFrame:
    """One value per exposure and keyword: that of the latest observe event."""
    last = F.max_by("value", F.struct("obs_time", "obs_event_id"))
    return values.groupBy("exposure_id", "keyword").agg(last.alias("value"))


def keyword_map(values: DataFrame) -> DataFrame:
    """One map per exposure of its keyword values; an exposure has at most as many as its mapping lists."""
    entries = F.sort_array(F.collect_list(F.struct("keyword", "value")))
    return values.groupBy("exposure_id").agg(F.map_from_entries(entries).alias("keywords"))

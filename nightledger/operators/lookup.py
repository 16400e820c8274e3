"""Snapshots of single past observe events, out of the archive."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightledger.operators.sizes import keep_values
from nightledger.operators.snapshot import OBSERVE_COLUMNS, event_snapshot
from nightledger.operators.state import EVENT_COLUMNS
from nightledger.session import brief_shuffles, scratch
from nightledger.sources import files
from nightledger.sources.landing import with_key

#: How many days before an observe event are searched first, then next; at last, all of them.
LOOKBACK_DAYS = (1, 30)


def day_spans(days: list[date], back: int) -> list[tuple[date, date]]:
    """The days from ``back`` before each day up to it, as spans that do not touch."""
    spans: list[tuple[date, date]] = []
    for day in sorted(days):
        low = day - timedelta(days=back)
        if spans and low <= spans[-1][1] + timedelta(days=1):
            spans[-1] = (spans[-1][0], day)
        else:
            spans.append((low, day))
    return spans


def in_spans(archive: DataFrame, spans: list[tuple[date, date]]) -> DataFrame:
    """The days of an archive that lie in a span, by its partition columns."""
    day = F.make_date("year", "month", "day")
    wanted = F.lit(False)
    for low, high in spans:
        wanted = wanted | day.between(F.lit(low), F.lit(high))
    return archive.filter(wanted)


def archive_snapshot(
    archive: DataFrame,
    observes: DataFrame,
    channels: DataFrame | None = None,
    lookback_days: tuple[int, ...] = LOOKBACK_DAYS,
    by_instant: bool = False,
) -> DataFrame:
    """What ``event_snapshot`` over the whole archive gives for these observe events, reading few days of it.

    The day of each observe event and the ones before it are searched for all channels; further back, only for the
    channels that are still without an answer, so that both days and channels prune the archive's partitions.
    A search that has gone over every day up to the last one is the only one. ``channels`` (a column ``event_key``) lists
    those there are; it is taken from the archive's partitions if not given.
    The answers of each search are written to the shared folder, unless it is the only one.
    """
    spark = archive.sparkSession
    observes = observes.filter(F.col("obs_time").isNotNull())
    days = [row[0] for row in observes.select(F.to_date("obs_time")).distinct().collect()]
    if not days:
        return event_snapshot(with_key(archive), observes=observes, by_instant=by_instant)
    asked = observes.count()
    day = F.make_date("year", "month", "day")
    until = archive.filter(day <= F.lit(max(days)))
    earliest = until.agg(F.min(day)).first()[0]
    channels = with_key(until.select("source", "eventName").distinct()).select("event_key") if channels is None else channels
    pair = ["obs_event_id", "obs_time", "event_key"]
    found: DataFrame | None = None
    keys: DataFrame | None = None
    path: str | None = None
    for back in (*lookback_days, None):
        spans = [] if back is None else day_spans(days, back)
        if len(spans) == 1 and (earliest is None or spans[0][0] <= earliest):
            back = None  # these are all days
        part = until if back is None else in_spans(archive, spans)
        rows = event_snapshot(with_key(part), keys=keys, observes=observes, by_instant=by_instant)
        if back is not None:  # an older event may come from the days of another observe event
            rows = rows.filter(F.col("eventTimeStamp") >= F.date_sub(F.to_date("obs_time"), back))
        rows = rows.select(*OBSERVE_COLUMNS, "event_key", *EVENT_COLUMNS)
        if back is None and found is None:
            return rows
        before = path
        if found is not None:
            rows = found.unionByName(rows.join(found.select(*pair), pair, "left_anti"))
        path = scratch(spark, "lookup")
        with brief_shuffles(spark):
            rows.write.parquet(path)
        if before is not None:
            files.remove(spark, before)
        found = spark.read.schema(rows.schema).parquet(path)
        answered = found.groupBy("event_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= asked)
        keys = channels.select("event_key").distinct().join(answered, "event_key", "left_anti")
        if back is None or keys.isEmpty():
            break
    return found

"""Data-quality rows: what the exposure tables would reject or silently miss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightledger.functions.keys import EXPOSURE_PARTS, exposure_parts, exposure_subsystem
from nightledger.operators.sizes import broadcast_if_small
from nightledger.schema import OBSERVE_EVENTS, TEXT_LIMIT

NO_EXPOSURE_ID = "NO_EXPOSURE_ID"
INVALID_FORMAT = "INVALID_FORMAT"
UNKNOWN_SUBSYSTEM = "UNKNOWN_SUBSYSTEM"


def with_subsystem(rows: DataFrame, subsystems: DataFrame) -> DataFrame:
    """Add the exposure's known ``subsystem`` and, where there is none, the ``reason``."""
    known = subsystems.select(F.upper("name").alias("subsystem"), F.lit(True).alias("_known")).distinct()
    reason = (
        F.when(F.col("exposure_id").isNull(), NO_EXPOSURE_ID)
        .when(F.size(exposure_parts(F.col("exposure_id"))) != EXPOSURE_PARTS, INVALID_FORMAT)
        .when(F.col("_known").isNull(), UNKNOWN_SUBSYSTEM)
    )
    return (
        rows.withColumn("subsystem", exposure_subsystem(F.col("exposure_id")))
        .join(broadcast_if_small(known), "subsystem", "left")
        .withColumn("reason", reason)
        .withColumn("subsystem", F.when(F.col("_known"), F.col("subsystem")))
        .drop("_known")
    )


def exposure_id_rejects(rows: DataFrame, subsystems: DataFrame) -> DataFrame:
    """Rows whose exposure id is missing, malformed or of an unknown subsystem, with a message."""
    shown = F.coalesce("exposure_id", F.lit(""))
    message = (
        F.when(F.col("reason") == NO_EXPOSURE_ID, F.lit("Observe event carries no exposure id"))
        .when(F.col("reason") == INVALID_FORMAT, F.concat(F.lit("Invalid format for exposure id "), shown))
        .otherwise(F.concat(F.lit("Invalid subsystem in exposure id "), shown))
    )
    return (
        with_subsystem(rows, subsystems)
        .filter(F.col("reason").isNotNull())
        .drop("subsystem")
        .withColumn("message", message)
    )


def _violation(column: str, limit: int | None) -> Column:
    value = F.col(column)
    found = F.when(value.isNull(), F.struct(F.lit(column).alias("column_name"), F.lit("NULL").alias("problem")))
    if limit is None:
        return found
    too_long = F.struct(F.lit(column).alias("column_name"), F.lit("TOO_LONG").alias("problem"))
    return found.when(F.char_length(value) > limit, too_long)


def row_constraints(rows: DataFrame, id_columns: list[str], text: list[str], required: list[str] = ()) -> DataFrame:
    """One row per broken rule: ``text`` columns must be present and short, ``required`` ones present."""
    checks = [_violation(c, TEXT_LIMIT) for c in text] + [_violation(c, None) for c in required]
    broken = F.explode(F.filter(F.array(*checks), lambda v: v.isNotNull()))
    return rows.select(*id_columns, broken.alias("v")).select(*id_columns, "v.*")


def before_all(observes: DataFrame, events: DataFrame, names: list[str] = OBSERVE_EVENTS) -> DataFrame:
    """Observe events for which a snapshot of ``events`` has no rows, without making it.

    A snapshot has some row for an observe event just when the very first event is at or before it, in the order of
    ``event_snapshot``: by time, then observe events after others, then event id. Observe events without a time have none.
    """
    order = [F.col("eventTimeStamp").alias("at"), F.col("eventName").isin(*names).alias("is_obs"), F.col("eventId").alias("id")]
    timed = events.filter(F.col("eventTimeStamp").isNotNull())
    earliest = timed.agg(F.min(F.struct(*order)).alias("e")).select(F.unix_micros("e.at").alias("at"), "e.is_obs", "e.id").first()
    if earliest.at is None:
        return observes
    at, first = F.unix_micros("obs_time"), F.lit(earliest.at)
    among = F.lit(not earliest.is_obs) | (F.lit(earliest.id) <= F.col("obs_event_id"))
    return observes.filter(~F.coalesce((first < at) | ((first == at) & among), F.lit(False)))


def empty_results(observes: DataFrame, events: DataFrame, values: DataFrame) -> DataFrame:
    """Observe events for which a snapshot of ``events`` has no rows, and those that gave no keyword values."""
    event = ["obs_event_id", "exposure_id", "obs_event_name"]
    seen = values.select("obs_event_id").distinct()
    without_keywords = observes.select(*event).join(seen, "obs_event_id", "left_anti").withColumn("missing", F.lit("KEYWORDS"))
    return before_all(observes, events).select(*event, F.lit("SNAPSHOT").alias("missing")).unionByName(without_keywords)


def header_coverage(header_lists: DataFrame, mappings: DataFrame) -> DataFrame:
    """Header keywords that no mapping fills, and mapped keywords that no header shows, compared without case."""
    key = ["subsystem", "keyword"]
    folded = [F.upper(name).alias(name) for name in key]
    listed = header_lists.select(*folded).distinct()
    mapped = mappings.select(*folded).distinct()
    return (
        listed.join(mapped, key, "left_anti")
        .withColumn("problem", F.lit("UNMAPPED"))
        .unionByName(mapped.join(listed, key, "left_anti").withColumn("problem", F.lit("UNUSED")))
    )

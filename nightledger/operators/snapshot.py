"""The state of every channel at each observe event: an as-of join whose hot channels shrink before they move."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nightledger.functions.params import value_at
from nightledger.operators.sizes import keep_values
from nightledger.operators.state import EVENT_COLUMNS
from nightledger.schema import OBSERVE_EVENTS

# Lengths, in seconds, a time cell may have, and the most observe events a cell should hold.
CELL_SECONDS = [86400 * 30, 86400 * 7, 86400, 21600, 3600, 600, 60, 10, 1]
CELL_OBSERVES = 128
# Observe events are broadcast, as times per cell or as rows, if that takes at most this much by a generous estimate.
BROADCAST_BYTES = 256 << 20
CELL_ROW_BYTES, OBSERVE_ROW_BYTES = 64, 256
# States are carried over cells in blocks of so many (two to the bits), over blocks in blocks of blocks, and so on.
CARRY_BITS = 10
CARRY_BLOCK = 1 << CARRY_BITS

OBSERVE_COLUMNS = ["obs_event_id", "obs_time", "exposure_id", "obs_event_name"]


def observe_exposure_id(params: Column) -> Column:
    """The exposure id an observe event carries, null if it has none."""
    return value_at(params["StringKey"], "exposureId")


def observe_events(bus: DataFrame, names: list[str] = OBSERVE_EVENTS) -> DataFrame:
    """``(obs_event_id, obs_time, exposure_id, obs_event_name)`` of the events that trigger a snapshot."""
    return bus.filter(F.col("eventName").isin(*names)).select(
        F.col("eventId").alias("obs_event_id"),
        F.col("eventTimeStamp").alias("obs_time"),
        observe_exposure_id(F.col("paramSet")).alias("exposure_id"),
        F.col("eventName").alias("obs_event_name"),
    )


def _cell(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_timestamp(ts) / seconds).cast("bigint")


class _Cells(NamedTuple):
    """Length of the time cells, the first and last observe time in microseconds, and how much there is."""

    seconds: int
    first: int | None
    last: int | None
    cells: int
    observes: int


def _counted(counts: DataFrame, at: Column, *by: str) -> DataFrame:
    """Counts added up by a time in seconds, with the first and last observe time."""
    return counts.groupBy(*by, at.cast("bigint").alias("at")).agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")
    )


def _per_length(counts: DataFrame, lengths: list[int]) -> DataFrame:
    """One row per candidate length: its densest cell, the first and last observe time, cells and observe events."""
    each = counts.withColumn("seconds", F.explode(F.array(*map(F.lit, lengths))))
    return (
        _counted(each, F.floor(F.col("at") / F.col("seconds")), "seconds")
        .groupBy("seconds")
        .agg(
            F.max("n").alias("densest"),
            F.unix_micros(F.min("first")).alias("first"),
            F.unix_micros(F.max("last")).alias("last"),
            F.count(F.lit(1)).alias("cells"),
            F.sum("n").alias("observes"),
        )
    )


def _choose_cells(observes: DataFrame, cell_seconds: int | None) -> _Cells:
    """The widest cell length that keeps observe events per cell low, or the given one.

    One job over the observe events alone; it brings back one row per candidate length. Observe events are counted by
    second and by minute first, so that what is counted once per length is at most the minutes there are.
    """
    candidates = CELL_SECONDS if cell_seconds is None else [cell_seconds]
    at = observes.filter(F.col("obs_time").isNotNull()).select(
        F.unix_timestamp("obs_time").alias("at"), F.lit(1).alias("n"), F.col("obs_time").alias("first"), F.col("obs_time").alias("last")
    )
    by_second = _counted(at, F.col("at"))
    by_minute = _counted(by_second, F.floor(F.col("at") / 60) * 60)
    coarse = [s for s in candidates if s % 60 == 0]
    parts = [_per_length(counts, lengths) for counts, lengths in [
        (by_second, [s for s in candidates if s % 60]), (by_minute, coarse)
    ] if lengths]
    found = reduce(DataFrame.unionByName, parts).collect()
    if not found:
        return _Cells(max(candidates), None, None, 0, 0)
    fitting = [row for row in found if row.densest <= CELL_OBSERVES]
    best = max(fitting, key=lambda row: row.seconds) if fitting else min(found, key=lambda row: row.seconds)
    return _Cells(best.seconds, best.first, best.last, best.cells, best.observes)


def _last_of(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The last row of every group. Each task keeps one row per group before anything is shuffled."""
    newest = Window.partitionBy(*group).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("newest", F.row_number().over(newest)).filter(F.col("newest") == 1).drop("newest")


def _carried(ends: DataFrame, asked: DataFrame, units: int, columns: list[str], small: bool) -> DataFrame:
    """``(event_key, at, *columns)``: what each channel brings into each asked unit from the units before it.

    ``ends`` holds a channel's last state in a unit ``at`` (0 to ``units`` - 1), ``asked`` the units ``at`` to answer.
    Units form blocks of ``CARRY_BLOCK``. What a channel brings into a block is found in the same way from the last
    states of the blocks; inside a block every state is given to the asked units from the next one on to the next unit
    with a state of its own. So no window holds more than ``CARRY_BLOCK`` + 1 rows. A state goes through the asked units
    of its block or through those it is valid for, whichever are fewer: the latter are at most a block for all states
    of a channel together.
    """
    block = F.shiftright("at", CARRY_BITS)
    rows = ends.select("event_key", block.alias("block"), "at", *columns)
    if units > CARRY_BLOCK:
        upper = _last_of(rows, ["event_key", "block"], ["at"]).select("event_key", F.col("block").alias("at"), *columns)
        blocks = asked.select(block.alias("at")).distinct()
        above = _carried(upper, blocks, -(-units // CARRY_BLOCK), columns, small)
        before = F.col("at") * CARRY_BLOCK - 1
        rows = rows.unionByName(above.select("event_key", F.col("at").alias("block"), before.alias("at"), *columns))
    units_of = asked.groupBy(block.alias("block")).agg(F.collect_set("at").alias("units"))
    following = F.lead("at").over(Window.partitionBy("event_key", "block").orderBy("at"))
    until = F.coalesce(following, (F.col("block") + 1) * CARRY_BLOCK - 1)
    among = F.filter("units", lambda unit: (unit > F.col("at")) & (unit <= F.col("until")))
    valid = F.sequence(F.col("at") + 1, F.col("until"))
    met = (
        F.when(F.size("units") < F.col("until") - F.col("at"), among)
        .when(F.size("units") == CARRY_BLOCK, valid)
        .otherwise(F.filter(valid, lambda unit: F.array_contains("units", unit)))
    )
    return (
        rows.withColumn("until", until)
        .filter(F.col("until") > F.col("at"))
        .join(F.broadcast(units_of) if small else units_of, "block")
        .select("event_key", F.explode(met).alias("at"), *columns)
    )


def event_snapshot(
    bus: DataFrame,
    names: list[str] = OBSERVE_EVENTS,
    keys: DataFrame | None = None,
    observes: DataFrame | None = None,
    cell_seconds: int | None = None,
    columns: list[str] = EVENT_COLUMNS,
    by_instant: bool = False,
) -> DataFrame:
    """For every observe event and channel, the channel's last event at or before it.

    ``bus`` has ``event_key`` and the event columns, observe events included; order is by time, then observe events
    after others, then event id. ``keys`` (a column ``event_key``) limits the channels; ``observes`` limits the observe
    events that are answered, which are otherwise all in ``bus``; it may have more columns, which the result then has as
    well. ``columns`` are those of the events to return; with
    few of them the shuffles are narrow. With ``by_instant``, observe events of one instant all see each other; the last
    by event id stands for its channel.

    Time is cut into cells that hold few observe events. Every event first learns the place, in its cell's list of
    observe events, of the first one that sees it, and is reduced to the last one per channel, cell and place before
    it is shuffled. The last state of a cell is carried into the later cells that hold observe events, block by block.
    A state then answers the places from its own up to that of the channel's next state in the cell, and only there are
    rows made for observe events. Windows hold at most the places of one cell or ``CARRY_BLOCK`` units, however many
    events a channel has; there is no join on a range.
    """
    observes = observe_events(bus, names) if observes is None else observes
    chosen = _choose_cells(observes, cell_seconds)
    seconds = chosen.seconds
    # Everything before the first observe event's cell only matters for what it carries in: one cell holds it all.
    last = F.timestamp_micros(F.lit(chosen.last).cast("bigint"))
    first_cell, last_cell = (0 if t is None else t // 10**6 // seconds for t in (chosen.first, chosen.last))
    earliest = first_cell - 1
    is_obs = F.col("eventName").isin(*names)
    events = bus.filter(F.col("eventTimeStamp") <= last)
    if keys is not None:
        events = keep_values(events, "event_key", keys)

    observes = observes.filter(F.col("obs_time").isNotNull())
    more = [c for c in observes.columns if c not in OBSERVE_COLUMNS]
    # Never null, for the same reason as the cells of events below: all uses of the lists share one shuffle.
    asking = observes.withColumn("cell", F.coalesce(_cell(F.col("obs_time"), seconds) - earliest, F.lit(0).cast("bigint")))
    asks = asking.groupBy("cell").agg(
        F.sort_array(F.collect_list(F.struct("obs_time", "obs_event_id", "exposure_id", "obs_event_name", *more))).alias("asks")
    )
    # Naming the lists, which are never empty, keeps this use of the aggregate the same as the others.
    asked = asks.filter(F.size("asks") > 0).select(F.col("cell").alias("at"))
    # Beyond the sizes checked here the joins shuffle; all are inner or left equi-joins that AQE splits when skewed.
    few = OBSERVE_ROW_BYTES * chosen.observes <= BROADCAST_BYTES
    if few:
        asks = F.broadcast(asks)
    small = CELL_ROW_BYTES * chosen.cells <= BROADCAST_BYTES

    # An observe event is seen from its own place on, any other event from the first place not before it; so are observe
    # events that see all of their instant.
    at, name = F.col("eventTimeStamp"), F.col("eventId")
    earlier = F.size(F.filter("asks.obs_time", lambda t: t < at))
    same = F.filter("asks", lambda ask: (ask["obs_time"] == at) & (ask["obs_event_id"] < name))
    own = F.lit(0) if by_instant else F.when(is_obs, F.size(same)).otherwise(0)
    place = F.coalesce(earlier + own, F.lit(0))
    order = ["eventTimeStamp", "is_obs", "eventId"]
    kept = list(dict.fromkeys([*columns, "eventTimeStamp", "eventId"]))
    # Cells are never null: a join would otherwise add a filter to one use of ``seen`` and keep its shuffle from being
    # shared by the others.
    cell = F.greatest(_cell(F.col("eventTimeStamp"), seconds), F.lit(earliest)) - earliest
    placed = (
        events.withColumn("cell", F.coalesce(cell, F.lit(0).cast("bigint")))
        .join(asks, "cell", "left")
        .select("event_key", "cell", place.alias("place"), is_obs.alias("is_obs"), *kept)
    )
    seen = _last_of(placed, ["event_key", "cell", "place"], order)
    if not few:
        # Joined by cell, the rows need no shuffle for their window, and all that follows would join them again.
        seen = seen.repartition("event_key", "cell")

    ends = _last_of(seen, ["event_key", "cell"], ["place"])
    ends = ends.select("event_key", F.col("cell").alias("at"), *kept)
    carried = _carried(ends, asked, last_cell - earliest + 1, kept, small)
    carried = carried.select("event_key", F.col("at").alias("cell"), F.lit(-1).alias("place"), *kept)

    following = F.lead("place").over(Window.partitionBy("event_key", "cell").orderBy("place"))
    answers = (
        seen.select("event_key", "cell", "place", *kept)
        .unionByName(carried)
        .withColumn("until", following)
        .join(asks, "cell")
        .withColumn("place", F.greatest("place", F.lit(0)))
        .withColumn("n", F.coalesce("until", F.size("asks")) - F.col("place"))
        .filter(F.col("n") > 0)
    )
    return answers.select(
        F.inline(F.slice("asks", F.col("place") + 1, F.col("n"))), "event_key", *columns
    ).select(*OBSERVE_COLUMNS, *more, "event_key", *columns)

"""Selecting events and point-in-time parameter queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightledger.functions.keys import glob_like
from nightledger.functions.params import value_at
from nightledger.operators.layout import TARGET_ROWS, TIME_ORDER, numbered
from nightledger.operators.sizes import SMALL_ROWS, broadcast_if_small
from nightledger.session import scratch


def by_key_pattern(events: DataFrame, patterns: list[str]) -> DataFrame:
    """Events whose channel key matches any of the globs; one row per event however many match."""
    matches = [glob_like(F.col("event_key"), p) for p in patterns]
    return events.filter(reduce(lambda a, b: a | b, matches, F.lit(False)))


def by_event_name(events: DataFrame, names: list[str]) -> DataFrame:
    """Events of the given names from any source."""
    return by_key_pattern(events, [f"*.*.{name}" for name in names])


def on_day(archive: DataFrame, year: int, month: int, day: int) -> DataFrame:
    """One day of the archive, by its partition columns."""
    return archive.filter((F.col("year") == year) & (F.col("month") == month) & (F.col("day") == day))


def in_time_range(archive: DataFrame, low: str, high: str) -> DataFrame:
    """Events between two instants, both included, compared as instants. The days between prune the partitions."""
    first, last = F.lit(low).cast("timestamp"), F.lit(high).cast("timestamp")
    day = F.make_date("year", "month", "day")
    return archive.filter(day.between(F.to_date(first), F.to_date(last)) & F.col("eventTimeStamp").between(first, last))


def of_channel(archive: DataFrame, source: str, event_name: str) -> DataFrame:
    """Events of one channel, by its partition columns."""
    return archive.filter((F.col("source") == source) & (F.col("eventName") == event_name))


def parameter(archive: DataFrame, type_key: str, key_name: str, index: int = 0) -> DataFrame:
    """``(eventTime, <key name>)``: one value of one parameter, null where an event lacks it."""
    return archive.select("eventTime", value_at(F.col(f"paramSet.{type_key}"), key_name, index).alias(key_name))


def single_event_query(
    archive: DataFrame,
    source: str,
    event_name: str,
    type_key: str,
    key_name: str,
    low: str | None = None,
    high: str | None = None,
    day: tuple[int, int, int] | None = None,
) -> DataFrame:
    """Time series of one parameter of one channel, within a day and a time range if given."""
    rows = archive if day is None else on_day(archive, *day)
    rows = rows if low is None or high is None else in_time_range(rows, low, high)
    return parameter(of_channel(rows, source, event_name), type_key, key_name)


def _hot_instants(left: DataFrame, right: DataFrame, hot_rows: int) -> DataFrame | None:
    """Instants with more than ``hot_rows`` rows on a side, with the rows of both; None if there are none."""
    one, none = F.lit(1), F.lit(0)
    times = left.select("eventTime", one.alias("a"), none.alias("b")).union(right.select("eventTime", none, one))
    if times.count() <= hot_rows:
        return None
    sizes = times.filter("eventTime IS NOT NULL").groupBy("eventTime").agg(F.sum("a").alias("_n"), F.sum("b").alias("_m"))
    hot = sizes.filter((F.col("_n") > hot_rows) | (F.col("_m") > hot_rows))
    path = scratch(left.sparkSession, "instants")
    hot.write.parquet(path)
    hot = left.sparkSession.read.schema(hot.schema).parquet(path)
    return None if hot.isEmpty() else hot


def multi_event_join(left: DataFrame, right: DataFrame, hot_rows: int = TARGET_ROWS) -> DataFrame:
    """Two time series side by side, rows of either without a partner kept, in time order.

    An instant with more than ``hot_rows`` rows on a side is dealt over a grid: its left rows over the grid's lines, its
    right rows over the columns, each repeated along the other side, so that every pair meets in one cell. Whether such
    an instant has partners at all follows from its counts, so no cell has to decide it. Rows without a time have no
    partner and are not shuffled for the join. Series are to be read from files, whose rows keep their numbers when a
    task runs again.
    """
    hot = _hot_instants(left, right, hot_rows)
    if hot is None:
        return left.join(right, "eventTime", "full_outer").orderBy("eventTime")
    hot = broadcast_if_small(hot)
    lefts, rights = ([c for c in side.columns if c != "eventTime"] for side in (left, right))
    a_names, b_names = [f"_a{i}" for i in range(len(lefts))], [f"_b{i}" for i in range(len(rights))]

    def sized(side: DataFrame, values: list[str], names: list[str]) -> DataFrame:
        numbered_rows = side.select(
            "eventTime",
            *[F.col(c).alias(n) for c, n in zip(values, names, strict=True)],
            F.monotonically_increasing_id().alias("_id"),
        )
        return numbered_rows.join(hot, "eventTime", "left")

    def cells(rows: str) -> Column:
        return F.ceil(F.col(rows) / hot_rows).cast("bigint")

    def own(rows: str) -> Column:
        return F.pmod("_id", F.greatest(cells(rows), F.lit(1)))

    def every(rows: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), cells(rows) - 1))

    a, b = sized(left, lefts, a_names), sized(right, rights, b_names)
    timed, is_hot = F.col("eventTime").isNotNull(), F.col("_n").isNotNull()
    shown = ["eventTime", *a_names, *b_names, "_line", "_column"]
    zero = F.lit(0).cast("bigint")

    def alone(side: DataFrame, rows: str, partners: str, missing: DataFrame, names: list[str]) -> DataFrame:
        place = F.when(is_hot, own(rows)).otherwise(F.col("_id"))
        kinds = {n: F.lit(None).cast(missing.schema[n].dataType) for n in names}
        lonely = side.filter(~timed | (is_hot & (F.col(partners) == 0)))
        return lonely.withColumns({**kinds, "_line": place, "_column": zero}).select(shown)

    cold = a.filter(timed & ~is_hot).drop("_id", "_n", "_m").join(
        b.filter(timed & ~is_hot).drop("_id", "_n", "_m"), "eventTime", "full_outer"
    )
    paired = is_hot & (F.col("_n") > 0) & (F.col("_m") > 0)
    line = a.filter(paired).select("eventTime", *a_names, own("_n").alias("_line"), every("_m").alias("_column"))
    column = b.filter(paired).select("eventTime", *b_names, own("_m").alias("_column"), every("_n").alias("_line"))
    joined = (
        cold.withColumns({"_line": zero, "_column": zero})
        .select(shown)
        .unionByName(line.join(column, ["eventTime", "_line", "_column"]).select(shown))
        .unionByName(alone(a, "_n", "_m", b, b_names))
        .unionByName(alone(b, "_m", "_n", a, a_names))
    )
    return joined.orderBy("eventTime", "_line", "_column").drop("_line", "_column").toDF("eventTime", *lefts, *rights)


def ordered_by_time(events: DataFrame) -> DataFrame:
    """Events in time order; the id breaks ties, so equal times do not end up in one task."""
    return events.orderBy(*TIME_ORDER)


def first_events(events: DataFrame, n: int, small: int = SMALL_ROWS) -> DataFrame:
    """The n earliest events. A sorted limit ends in one task, so it is only used for few rows."""
    if n <= small:
        return ordered_by_time(events).limit(n)
    return numbered(events, TIME_ORDER).filter(F.col("row_no") < n).orderBy("row_no").drop("row_no")


def row_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n_rows"))

"""How rows are spread over tasks and files, and numbering rows without a single-task window."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nightledger.operators.sizes import SMALL_ROWS, broadcast_if_small
from nightledger.schema import CHANNEL_COLUMNS
from nightledger.session import scratch

# Rows one task writes into one table partition before the partition is split by time.
TARGET_ROWS = 5_000_000
# Rows a task sorts, of one or several table partitions, before more tasks are used than shuffles are set to.
TASK_ROWS = 500_000
TIME_ORDER = ["eventTimeStamp", "eventId"]


def tasks_for(spark: SparkSession, rows: int, task_rows: int = TASK_ROWS) -> int:
    """As many tasks as shuffles are set to, or as ``rows`` need at ``task_rows`` each if these are more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // task_rows))


def by_channel(archive: DataFrame, rows: int = 0) -> DataFrame:
    """One task per table partition. With ``rows``, their number, a task gets no more partitions than it should sort."""
    tasks = tasks_for(archive.sparkSession, rows)
    if tasks == tasks_for(archive.sparkSession, 0):
        return archive.repartition(*CHANNEL_COLUMNS)
    return archive.repartition(tasks, *CHANNEL_COLUMNS)


def channel_layout(archive: DataFrame, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Rows placed for a partitioned write, time-ordered inside each file.

    A table partition of ordinary size has one task. One with more than ``target_rows`` rows (a hot channel) is range
    partitioned by time over as many tasks as its size asks for, so its files hold consecutive time ranges.
    Sizes are counted over the partition columns alone before anything is moved.
    """
    sizes = archive.groupBy(*CHANNEL_COLUMNS).count()
    hot = sizes.filter(F.col("count") > target_rows)
    is_hot = F.col("count") > target_rows
    n_hot, hot_rows, n_rows = sizes.agg(
        F.count_if(is_hot), F.sum(F.when(is_hot, F.col("count"))), F.coalesce(F.sum("count"), F.lit(0))
    ).first()
    if n_hot == 0:
        placed = by_channel(archive, n_rows)
    else:
        tasks = math.ceil(hot_rows / target_rows)
        hot = F.broadcast(hot) if n_hot <= SMALL_ROWS else hot
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"h.{c}")) for c in CHANNEL_COLUMNS]
        a, h = archive.alias("a"), hot.alias("h")
        cold_part = by_channel(a.join(h, same, "left_anti"), n_rows - hot_rows)
        hot_part = a.join(h, same, "left_semi").repartitionByRange(tasks, *CHANNEL_COLUMNS, *TIME_ORDER)
        placed = cold_part.unionByName(hot_part)
    return placed.sortWithinPartitions(*CHANNEL_COLUMNS, *TIME_ORDER)


def numbered(rows: DataFrame, order: list[str], tasks: int | None = None) -> DataFrame:
    """Add ``row_no``, 0, 1, 2 … over the whole table in a total order, with no task holding more than its share.

    Rows are range partitioned by the order, numbered inside each range, and moved up by the sizes of the ranges
    before. The ranges are written to the shared folder, so that both passes see the same ones and a lost executor
    changes nothing; ``order`` must be unique.
    """
    spark = rows.sparkSession
    path = scratch(spark, "numbered")
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = F.monotonically_increasing_id()
    ranged = (
        rows.repartitionByRange(tasks, *order)
        .sortWithinPartitions(*order)
        .withColumn("_range", F.shiftright(local, 33).cast("int"))
        .withColumn("_local", local.bitwiseAND(F.lit((1 << 33) - 1)))
    )
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    # One row per range, so the window and the broadcast hold at most ``tasks`` rows whatever the data.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    )
    return (
        ranged.join(F.broadcast(starts), "_range")
        .withColumn("row_no", F.col("_start") + F.col("_local"))
        .drop("_range", "_local", "_start")
    )


MICROS = {"second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6}

#: Rows of one instant above which they are numbered over several tasks, by ranges of the event id.
HOT_ROWS = 1_000_000

#: Batches of one instant that a single step spreads into rows.
SPREAD = 100_000


def micros_of(duration: str) -> int:
    count, unit = duration.split()
    return int(count) * MICROS[unit.rstrip("s")]


def tumbling(ts: Column, duration: str) -> Column:
    """Start of the fixed window the time falls into; null for a null time, which keeps its row."""
    return F.timestamp_micros(F.unix_micros(ts) - F.pmod(F.unix_micros(ts), F.lit(micros_of(duration))))


def instants(events: DataFrame, duration: str) -> DataFrame:
    """A row per time that occurs: window_start, ts, n (its rows) and first (rows before it in its window).

    Only times are shuffled, counted before they move. A window is cut into parts whose length is the root of its own
    in microseconds, so that no task orders more times than a part has, or more parts than a window has (3,163 and
    3,163 of 10 seconds, 293,939 and 293,939 of a day), however many rows there are. Rows without a time are one instant.
    """
    length = micros_of(duration)
    part = math.isqrt(length - 1) + 1
    ts = F.col("eventTimeStamp").alias("ts")
    offset = F.coalesce(F.pmod(F.unix_micros("ts"), F.lit(length)), F.lit(0))
    counted = events.groupBy(ts).agg(F.count(F.lit(1)).alias("n")).select(
        "ts", "n", tumbling(F.col("ts"), duration).alias("window_start"), F.floor(offset / part).alias("part")
    )
    before = Window.partitionBy("start").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    parts = counted.groupBy(F.col("window_start").alias("start"), F.col("part").alias("at")).agg(F.sum("n").alias("size"))
    parts = parts.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0)))
    inside = Window.partitionBy("window_start", "part").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    return (
        counted.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(parts, F.col("window_start").eqNullSafe(F.col("start")) & (F.col("part") == F.col("at")))
        .select("window_start", "ts", "n", (F.col("base") + F.col("inside")).alias("first"))
    )


def time_count_chunks(events: DataFrame, max_rows: int, duration: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Split events into batches that end after ``max_rows`` rows or at the end of a time window.

    Adds ``window_start`` and ``chunk`` (0, 1, … inside a window), in order of time and event id. Events without a
    valid time are a window of their own, whose start is null.

    Rows are shuffled once, by their time; their number in the window is the number of rows before their instant and
    their rank by event id in it. Instants above ``hot_rows`` rows, also that of events without a time, are numbered apart.
    """
    at = instants(events, duration)
    key = F.coalesce(F.unix_micros("eventTimeStamp"), F.lit(-(1 << 63)))
    rows = events.withColumn("_at", key)
    firsts = at.select(
        F.coalesce(F.unix_micros("ts"), F.lit(-(1 << 63))).alias("_time"), "window_start", F.col("first").alias("_first")
    )
    rank = F.row_number().over(Window.partitionBy("_at").orderBy("eventId")).cast("long") - 1
    hot = events.groupBy(key.alias("_time")).count().filter(F.col("count") > hot_rows).select("_time")
    if hot.isEmpty():
        ranked = rows.withColumn("_rank", rank).join(firsts, F.col("_at") == F.col("_time"))
    else:
        hot = broadcast_if_small(hot)
        cold = rows.join(hot, F.col("_at") == F.col("_time"), "left_anti").withColumn("_rank", rank)
        crowded = numbered(rows.join(hot, F.col("_at") == F.col("_time"), "left_semi"), TIME_ORDER)
        starts = crowded.groupBy(F.col("_at").alias("_time")).agg(F.min("row_no").alias("_start"))
        crowded = crowded.join(broadcast_if_small(starts), F.col("_at") == F.col("_time"))
        crowded = crowded.withColumn("_rank", F.col("row_no") - F.col("_start")).drop("row_no", "_start", "_time")
        few = broadcast_if_small(firsts.join(hot, "_time", "left_semi"))
        same = F.col("_at") == F.col("_time")
        ranked = cold.join(firsts, same).unionByName(crowded.join(few, same))
    chunk = F.floor((F.col("_first") + F.col("_rank")) / max_rows).cast("bigint")
    return ranked.select(*events.columns, "window_start", chunk.alias("chunk"))


def batch_stats(events: DataFrame, max_rows: int, duration: str) -> DataFrame:
    """Size and time span of each batch of ``time_count_chunks``, from the counts of instants alone.

    Which rows of an instant fall into which batch does not matter here, so no row is numbered or moved.
    """
    first, end, chunk = F.col("first"), F.col("first") + F.col("n"), F.col("chunk")
    last = F.floor((end - 1) / max_rows)
    steps = instants(events, duration).withColumn("step", F.explode(F.sequence(F.floor(first / max_rows), last, F.lit(SPREAD))))
    spread = steps.withColumn("chunk", F.explode(F.sequence(F.col("step"), F.least(F.col("step") + SPREAD - 1, last))))
    covered = F.least(end, (chunk + 1) * max_rows) - F.greatest(first, chunk * max_rows)
    return (
        spread.withColumn("covered", covered)
        .groupBy("window_start", "chunk")
        .agg(F.sum("covered").alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    )

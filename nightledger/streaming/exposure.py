"""Channel state, snapshots and keyword values kept up to date by one stream.

Events may arrive out of order. A micro-batch first stores its events, then answers its own observe events, and answers
again those of the last ``lateness_seconds`` that its earliest event could change; so what is stored does not depend on
how files were admitted. Readers take an observe event's rows from the newest answer to it. State lies in generations
(see ``generations``).

An event older than the lateness counts for the state of its channel and is kept in the ``late`` table. It may change
answers that were given long before, and an observe event as old as that cannot be answered from a state that has let go
of its past. ``reconcile`` mends both: late observe events are looked up in the archive, by day and channel, and stored
answers take over late events where these are newer than what they hold; where that may be so of very many answers, all
of that time are looked up in the archive instead, which shuffles events and not answers. Late events, and those without
a valid time, are listed in the rejects as well.

All rows are written under their batch id; running a batch again replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from nightledger.operators.keywords import asked_params, keyword_extract
from nightledger.operators.lookup import archive_snapshot
from nightledger.operators.sizes import SMALL_ROWS, broadcast_if_small
from nightledger.operators.snapshot import OBSERVE_COLUMNS, event_snapshot, observe_events
from nightledger.operators.state import EVENT_COLUMNS, latest_per_key
from nightledger.schema import OBSERVE_EVENTS
from nightledger.session import brief_shuffles, scratch
from nightledger.sources import files
from nightledger.sources.archive import archive_rows
from nightledger.sources.landing import with_key
from nightledger.sources.tables import SNAPSHOT_COLUMNS, snapshot_table, write_keyword_values
from nightledger.streaming import generations

SNAPSHOTS = "snapshots"
KEYWORDS = "keywords"
REJECTS = "rejects"
LATE_EVENTS = "late"
RECONCILED = "reconciled"
BATCH = "batch_id"
REVISION = "revision"

LATENESS_SECONDS = 60
# Before and after every time in microseconds.
EARLIEST, LATEST = -(1 << 62), 1 << 62
# Stored answers that late events may change are merged with these up to so many, and looked up in the archive beyond.
MERGED_ANSWERS = SMALL_ROWS
NO_VALID_TIME = "NO_VALID_TIME"
LATE = "LATE"

Mappings = Callable[[SparkSession], DataFrame]


def prepare_tables(spark: SparkSession, root: str, params: T.StructType) -> None:
    """Make sure the stream's tables exist, so that they can be read before anything is written."""
    for table in (SNAPSHOTS, KEYWORDS, REJECTS, LATE_EVENTS, RECONCILED, generations.GENERATIONS):
        files.make_folder(spark, f"{root}/{table}")


def read_state(spark: SparkSession, root: str, params: T.StructType, below: int | None = None) -> DataFrame:
    """The last event per channel in the newest state, or in the newest one of an earlier batch than ``below``."""
    return latest_per_key(generations.read_generation(spark, root, below).known(spark, params))


def _write_batch(rows: DataFrame, root: str, table: str, batch_id: int) -> str:
    path = f"{root}/{table}/{BATCH}={batch_id}"
    with brief_shuffles(rows.sparkSession):
        rows.write.mode("overwrite").parquet(path)
    return path


def _stored(rows: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows as written to the shared folder, and where."""
    path = scratch(rows.sparkSession, name)
    with brief_shuffles(rows.sparkSession):
        rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path), path


def _write_answers(
    snapshot: DataFrame, observes: Callable[[DataFrame], DataFrame], root: str, batch_id: int, revision: int, mappings: Mappings | None
) -> None:
    """Store snapshots and, with ``mappings``, the keyword values of ``observes`` (made from the stored snapshots)."""
    spark = snapshot.sparkSession
    path = f"{root}/{SNAPSHOTS}/{BATCH}={batch_id}/{REVISION}={revision}"
    with brief_shuffles(spark):
        snapshot.write.mode("overwrite").parquet(path)
        if mappings is not None:
            stored, rules = spark.read.schema(snapshot.schema).parquet(path), mappings(spark)
            values = keyword_extract(observes(stored), asked_params(stored, rules), rules)
            write_keyword_values(values, f"{root}/{KEYWORDS}", batch_id, revision)


def process_batch(
    events: DataFrame,
    batch_id: int,
    root: str,
    mappings: Mappings | None = None,
    lateness_seconds: int = LATENESS_SECONDS,
    by_instant: bool = False,
) -> None:
    """State, snapshots, late events, rejects and, with ``mappings``, keyword values of one micro-batch."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    before, name = generations.begin(spark, root, batch_id)
    parsed = with_key(archive_rows(events)).select("event_key", *EVENT_COLUMNS, "eventTime")
    path = f"{root}/{generations.RECENT}/{name}"
    parsed.write.parquet(path)
    rows = spark.read.schema(parsed.schema).parquet(path)
    bus = rows.filter(F.col("eventTimeStamp").isNotNull()).drop("eventTime")
    params = bus.schema["paramSet"].dataType

    at = F.unix_micros("eventTimeStamp")
    lateness = lateness_seconds * 10**6
    horizon = EARLIEST if before.newest is None else before.newest - lateness
    on_time = F.min(F.when(at >= horizon, at))
    first, last, first_on_time, late = bus.agg(F.min(at), F.max(at), on_time, F.count_if(at < horizon)).first()

    changed_from = LATEST if first_on_time is None else first_on_time
    again = before.events(spark, params, since=changed_from)
    observes = observe_events(bus.filter(at >= horizon).unionByName(again), OBSERVE_EVENTS)
    snapshot = event_snapshot(before.known(spark, params).unionByName(bus), observes=observes, by_instant=by_instant)
    _write_answers(snapshot, lambda _: observes, root, batch_id, 0, mappings)

    if late:
        _write_batch(bus.filter(at < horizon), root, LATE_EVENTS, batch_id)
    reason = F.when(F.col("eventTimeStamp").isNull(), NO_VALID_TIME).when(at < horizon, LATE)
    rejects = rows.select("eventId", "source", "eventName", "eventTime", reason.alias("reason"))
    _write_batch(rejects.filter(F.col("reason").isNotNull()), root, REJECTS, batch_id)

    generations.finish(spark, before, name, params, first, last, lateness)


#: Holds for a row of an observe event's own channel, in which nothing later than itself can stand.
_OWN = "eventTimeStamp = obs_time AND eventName = obs_event_name"


def _own_rows(snapshots: DataFrame) -> DataFrame:
    """The observe events of stored snapshots: each has the row of its own event in it, or of one like it."""
    return snapshots.filter(_OWN).select(*OBSERVE_COLUMNS).distinct()


_EVENT = ["obs_event_id", "obs_time"]
_ANSWER_COLUMNS = [*OBSERVE_COLUMNS, "event_key", *EVENT_COLUMNS]


def _open_range(stored: DataFrame, late: DataFrame) -> tuple[int, int]:
    """The first and last time, in microseconds, of the observe events whose stored answers late events may change.

    An answer is settled if it has something newer than the last late event of every channel. What a channel shows only
    gets newer with time, so the last channel to show something newer for the first time ends the range. That takes a row
    per channel; so do the counts that say whether all answers after it are settled, as they are if none lacks a
    channel. Only if some do, answers are counted one by one.
    """
    at = F.unix_micros("obs_time")
    first = late.agg(F.unix_micros(F.min("eventTimeStamp"))).first()[0]
    reached = stored.filter(at >= first)
    ends = late.groupBy("event_key").agg(F.max("eventTimeStamp").alias("end"))
    channels = ends.count()
    newest = reached.join(broadcast_if_small(ends), "event_key").filter(F.col("eventTimeStamp") > F.col("end"))
    shown, since = newest.groupBy("event_key").agg(F.min(at).alias("since")).agg(F.count(F.lit(1)), F.max("since")).first()
    if shown < channels:
        return first, LATEST

    def last_open(time: Column) -> int | None:
        settled = newest.filter(time).groupBy(*_EVENT).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= channels)
        return _own_rows(reached.filter(time)).join(settled, _EVENT, "left_anti").agg(F.max(at)).first()[0]

    after = at > since
    answers = _own_rows(reached.filter(after)).count()
    counts = newest.filter(after).groupBy("event_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == answers)
    until = None if answers == 0 or counts.count() == channels else last_open(after)
    if until is None:
        until = last_open(at == since)
    return first, since - 1 if until is None else until


def _with_late_events(reached: DataFrame, open_ones: DataFrame, late: DataFrame, by_instant: bool = False) -> DataFrame:
    """Those among the snapshots ``reached``, of the observe events ``open_ones``, that late events change, with the change.

    The last event at or before an observe event is the later one of the last among all others and the last among the
    late ones; the former are stored, and a snapshot over the late events alone gives the latter. Written to the shared
    folder.
    """
    newer = event_snapshot(late, observes=open_ones, by_instant=by_instant)
    columns = _ANSWER_COLUMNS
    both = reached.select(*columns, F.lit(0).alias("late")).unionByName(newer.select(*columns, F.lit(1).alias("late")))
    order = ["eventTimeStamp", F.col("eventName").isin(*OBSERVE_EVENTS), "eventId"]
    last = Window.partitionBy("obs_event_id", "obs_time", "event_key").orderBy(*[F.desc(c) if isinstance(c, str) else c.desc() for c in order], "late")
    merged, _ = _stored(both.withColumn("n", F.row_number().over(last)).filter("n = 1").drop("n"), "reconciled")
    changed = merged.filter("late = 1").select(*_EVENT).distinct()
    return merged.join(changed, _EVENT, "left_semi").drop("late")


def reconcile(
    spark: SparkSession,
    root: str,
    archive: DataFrame,
    params: T.StructType,
    mappings: Mappings | None = None,
    by_instant: bool = False,
) -> int:
    """Answer late observe events, and mend the answers that late events change; returns how many batches had any.

    ``archive`` must hold what the stream has read so far. To be run from time to time, also while the stream runs: an
    answer of a later batch counts more, and holds the late events seen until then. What has been reconciled is noted
    last; a run that fails is repeated whole.
    """
    batch_id = generations.newest_batch(spark, root)
    if batch_id is None:
        return 0
    notes = f"{root}/{RECONCILED}"
    files.make_folder(spark, notes)
    note = files.newest(spark, notes)
    done = -1 if note is None else files.read_json(spark, f"{notes}/{note}")["through"]
    found = [int(n.partition("=")[2]) for n in files.names(spark, f"{root}/{LATE_EVENTS}")]
    new = sorted(b for b in found if done < b <= batch_id)
    if not new:
        return 0
    schema = generations.state_schema(params)
    late = spark.read.schema(schema).parquet(*[f"{root}/{LATE_EVENTS}/{BATCH}={b}" for b in new])
    revision = files.next_attempt(spark, notes, batch_id) + 1
    channels = read_state(spark, root, params).select("event_key")
    note, observes = {"through": new[-1]}, observe_events(late)
    stored = stored_snapshots(spark, root, params)
    first, until = _open_range(stored, late)
    reached = stored.filter(F.unix_micros("obs_time").between(first, until))
    open_ones, path = _stored(_own_rows(reached), "reachable")
    spent = [path]
    if open_ones.count() <= MERGED_ANSWERS:
        mended = _with_late_events(reached, open_ones, late, by_instant)
        looked_up = archive_snapshot(archive, observes, channels, by_instant=by_instant)
        answers = looked_up.select(*_ANSWER_COLUMNS).unionByName(mended.select(*_ANSWER_COLUMNS))
    else:
        # A run that failed may have answered late observe events already.
        again = open_ones.join(observes.select(*_EVENT), _EVENT, "left_anti").select(*OBSERVE_COLUMNS)
        asked, path = _stored(observes.unionByName(again), "asked")
        spent.append(path)
        answers = archive_snapshot(archive, asked, channels, by_instant=by_instant).select(*_ANSWER_COLUMNS)
        note |= {"first": first, "until": until}
    _write_answers(answers, _own_rows, root, batch_id, revision, mappings)
    files.write_json(spark, notes, files.numbered(batch_id, revision - 1), note)
    for path in spent:
        files.remove(spark, path)
    return len(new)


def start_exposures(
    events: DataFrame,
    root: str,
    checkpoint: str,
    mappings: Mappings | None = None,
    trigger: dict | None = None,
    lateness_seconds: int = LATENESS_SECONDS,
    by_instant: bool = False,
) -> StreamingQuery:
    """Run ``process_batch`` over a stream of landed events. ``mappings`` builds the merged, classified mappings.

    ``by_instant`` is that of ``event_snapshot``; ``reconcile`` is to be given the same.
    """
    prepare_tables(events.sparkSession, root, events.schema["paramSet"].dataType)

    def each(rows: DataFrame, batch_id: int) -> None:
        process_batch(rows, batch_id, root, mappings, lateness_seconds, by_instant)

    return (
        events.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "2 seconds"}))
        .start()
    )


def _observe_schema() -> T.StructType:
    return (
        T.StructType()
        .add("obs_event_id", T.StringType())
        .add("obs_time", T.TimestampType())
        .add("exposure_id", T.StringType())
        .add("obs_event_name", T.StringType())
    )


def _order() -> Column:
    """Answers of later batches count more, and of one batch the later revisions."""
    return F.col(BATCH) * (1 << 20) + F.col(REVISION)


def _answered_whole(spark: SparkSession, root: str) -> list[tuple[int, int, int]]:
    """(order of its answers, first and last time) of each reconciliation that answered all observe events of a time again."""
    found: list[tuple[int, int, int]] = []
    for name in reversed(files.names(spark, f"{root}/{RECONCILED}")):
        note = files.read_json(spark, f"{root}/{RECONCILED}/{name}")
        if "first" in note and not any(first <= note["first"] and note["until"] <= until for _, first, until in found):
            found.append((int(name[:19]) * (1 << 20) + int(name[20:26]) + 1, note["first"], note["until"]))
    return found


def _newest_answers(spark: SparkSession, root: str, rows: DataFrame) -> DataFrame:
    """Those of ``rows`` that belong to the newest answer to their observe event.

    What a reconciliation has answered whole goes by its time. Few other answers are replaced; they are found in the
    snapshots, in which an observe event has at least the row of its own channel, so that ``rows`` need not be shuffled.
    """
    ranges, at = _answered_whole(spark, root), F.unix_micros("obs_time")

    def current(answers: DataFrame) -> DataFrame:
        for order, first, until in ranges:
            answers = answers.filter((_order() >= order) | ~at.between(first, until))
        return answers

    own = [T.StructField("eventTimeStamp", T.TimestampType()), T.StructField("eventName", T.StringType())]
    answers = current(spark.read.schema(_answer_schema(*own)).parquet(f"{root}/{SNAPSHOTS}").filter(_OWN))
    given = answers.select(*_EVENT, _order().alias("answer")).distinct()
    several = given.groupBy(*_EVENT).agg(F.sort_array(F.collect_set("answer")).alias("answers"))
    several = several.filter(F.size("answers") > 1)
    replaced = several.select(*_EVENT, F.explode(F.slice("answers", 1, F.size("answers") - 1)).alias("answer"))
    replaced = broadcast_if_small(_stored(replaced, "replaced")[0])
    kept = current(rows).withColumn("answer", _order()).join(replaced, [*_EVENT, "answer"], "left_anti")
    return kept.drop("answer", BATCH, REVISION)


def _answer_schema(*fields: T.StructField) -> T.StructType:
    return T.StructType([*_observe_schema().fields, *fields]).add(BATCH, T.LongType()).add(REVISION, T.IntegerType())


def stored_snapshots(spark: SparkSession, root: str, params: T.StructType) -> DataFrame:
    """The snapshots the stream wrote, each as last revised."""
    schema = _answer_schema(*generations.state_schema(params).fields)
    return _newest_answers(spark, root, spark.read.schema(schema).parquet(f"{root}/{SNAPSHOTS}"))


def stored_rejects(spark: SparkSession, root: str) -> DataFrame:
    """Events that came later than the lateness allows, or without a valid time."""
    names = ["eventId", "source", "eventName", "eventTime", "reason"]
    schema = T.StructType([T.StructField(name, T.StringType()) for name in names])
    return spark.read.schema(schema).parquet(f"{root}/{REJECTS}").select(*names)


def stored_snapshot_table(spark: SparkSession, root: str, params: T.StructType) -> DataFrame:
    """The same in the columns of the snapshot table, parameters as JSON text."""
    return snapshot_table(stored_snapshots(spark, root, params)).select(*SNAPSHOT_COLUMNS)


def stored_keyword_values(spark: SparkSession, root: str) -> DataFrame:
    """The keyword values the stream wrote, each observe event's as last revised."""
    schema = _answer_schema(T.StructField("keyword", T.StringType()), T.StructField("value", T.StringType()))
    rows = spark.read.schema(schema).parquet(f"{root}/{KEYWORDS}").filter(F.col("obs_event_id").isNotNull())
    return _newest_answers(spark, root, rows)

"""Streams against their batch twins: micro-batches, replays, late events, restarts."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from nightledger.operators import lookup
from nightledger.operators.keywords import keyword_extract
from nightledger.operators.snapshot import event_snapshot, observe_events
from nightledger.operators.state import latest_per_key
from nightledger.plans import fixtures as fx
from nightledger.session import scratch
from nightledger.sources import archive as store
from nightledger.sources import files, landing
from nightledger.sources.landing import read_landing, read_landing_stream, write_landing
from nightledger.streaming import convert, exposure, generations
from tests import helpers as h

NOW = {"availableNow": True}


def batches(seed=5, n=240, parts=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = i * 1_000_000 + rng.randrange(900_000)
        if i % 12 == 7:
            instrument = rng.choice(["IRIS", "WFOS"])
            rows.append(h.observe(f"o{i}", at, f"2020A-001-123-{instrument}-IMG-SCI0-{i:04d}"))
        else:
            rows.append(h.event(f"e{i}", f"event_key_{rng.choice([1, 3, 5, 9])}", at, i, "ESW.filter"))
    size = n // parts
    return rows, [rows[i * size : (i + 1) * size] for i in range(parts)]


def run(spark, root, part):
    write_landing(h.landed(spark, part), f"{root}/landing")
    stream = read_landing_stream(spark, f"{root}/landing", fx.EVENT)
    exposure.start_exposures(stream, root, f"{root}/cp", fx.mappings, NOW).awaitTermination()


def states(spark, root):
    return {r.event_key: r.eventId for r in exposure.read_state(spark, root, fx.PARAMS).collect()}


def test_stream_equals_batch_and_survives_restarts(spark):
    rows, parts = batches()
    root = scratch(spark, "stream")
    for part in parts:
        run(spark, root, part)
    assert h.snapshot_dict(exposure.stored_snapshots(spark, root, fx.PARAMS)) == h.brute_force_snapshot(rows)
    batch_state = {r.event_key: r.eventId for r in latest_per_key(h.bus(spark, rows)).collect()}
    assert states(spark, root) == batch_state
    values = exposure.stored_keyword_values(spark, root)
    assert values.groupBy("obs_event_id", "keyword").count().filter("count > 1").count() == 0
    assert values.filter("keyword = 'TEMP'").count() > 0
    table = exposure.stored_snapshot_table(spark, root, fx.PARAMS)
    assert table.columns == ["exposure_id", "obs_event_name", "source", "eventname", "eventid", "eventtime", "paramset"]
    assert table.filter("paramset like '%temperature%'").count() > 0


def test_replayed_batch_changes_nothing(spark):
    rows, parts = batches(seed=6)
    root = scratch(spark, "replay")
    exposure.prepare_tables(spark, root, fx.PARAMS)
    for batch_id, part in [(0, parts[0]), (1, parts[1]), (1, parts[1]), (4, parts[2]), (4, parts[2])]:
        exposure.process_batch(h.landed(spark, part), batch_id, root, fx.mappings)
    assert h.snapshot_dict(exposure.stored_snapshots(spark, root, fx.PARAMS)) == h.brute_force_snapshot(rows)
    values = exposure.stored_keyword_values(spark, root)
    assert values.groupBy("obs_event_id", "keyword").count().filter("count > 1").count() == 0


def test_late_event_does_not_replace_newer_state(spark):
    root = scratch(spark, "late")
    exposure.prepare_tables(spark, root, fx.PARAMS)
    exposure.process_batch(h.landed(spark, [h.event("new", "event_key_1", 100), h.observe("o1", 200)]), 0, root)
    exposure.process_batch(h.landed(spark, [h.event("old", "event_key_1", 50), h.observe("o2", 300)]), 1, root)
    assert states(spark, root)["IRIS.filter.event_key_1"] == "new"
    got = h.snapshot_dict(exposure.stored_snapshots(spark, root, fx.PARAMS))
    assert got[("o2", h.iso(300), "IRIS.filter.event_key_1")] == "new"


@pytest.mark.parametrize("files_per_trigger", [1, 3, 300])
def test_stream_does_not_depend_on_admission(spark, files_per_trigger):
    rows, _ = batches(seed=8, n=96)
    shuffled = random.Random(9).sample(rows, len(rows))
    root = scratch(spark, "shuffled")
    for part in range(4):
        write_landing(h.landed(spark, shuffled[part * 24 : part * 24 + 24]).coalesce(1), f"{root}/landing")
    stream = read_landing_stream(spark, f"{root}/landing", fx.EVENT, files_per_trigger)
    exposure.start_exposures(stream, root, f"{root}/cp", fx.mappings, NOW, lateness_seconds=100).awaitTermination()
    stored = exposure.stored_snapshots(spark, root, fx.PARAMS)
    expected = h.brute_force_snapshot(rows)
    assert h.snapshot_dict(stored) == expected
    assert stored.count() == len(expected)
    bus = h.bus(spark, rows)
    observes = observe_events(bus)
    values = keyword_extract(observes, event_snapshot(bus, observes=observes), fx.mappings(spark))
    got = exposure.stored_keyword_values(spark, root).select(values.columns)
    assert got.exceptAll(values).count() == 0 and values.exceptAll(got).count() == 0
    assert exposure.stored_rejects(spark, root).count() == 0


def test_late_observe_event_sees_earlier_states(spark):
    root = scratch(spark, "late-observe")
    exposure.prepare_tables(spark, root, fx.PARAMS)
    early = [h.event("e50", "event_key_1", 50), h.event("e100", "event_key_1", 100)]
    exposure.process_batch(h.landed(spark, early), 0, root)
    exposure.process_batch(h.landed(spark, [h.observe("o70", 70)]), 1, root)
    got = h.snapshot_dict(exposure.stored_snapshots(spark, root, fx.PARAMS))
    assert got[("o70", h.iso(70), "IRIS.filter.event_key_1")] == "e50"


def test_events_beyond_the_lateness_are_listed(spark):
    root = scratch(spark, "beyond")
    exposure.prepare_tables(spark, root, fx.PARAMS)
    second = 10**6
    first = [h.event("base", "event_key_1", 0), h.observe("o5", 5 * second), h.event("new", "event_key_3", 90 * second)]
    exposure.process_batch(h.landed(spark, first), 0, root, lateness_seconds=10)
    late = [h.event("late", "event_key_1", 2 * second), h.observe("o95", 95 * second)]
    exposure.process_batch(h.landed(spark, late), 1, root, lateness_seconds=10)
    got = h.snapshot_dict(exposure.stored_snapshots(spark, root, fx.PARAMS))
    assert got[("o5", h.iso(5 * second), "IRIS.filter.event_key_1")] == "base"
    assert got[("o95", h.iso(95 * second), "IRIS.filter.event_key_1")] == "late"
    assert [(r.eventId, r.reason) for r in exposure.stored_rejects(spark, root).collect()] == [("late", exposure.LATE)]


def test_batch_without_observe_events_updates_state(spark):
    root = scratch(spark, "quiet")
    exposure.prepare_tables(spark, root, fx.PARAMS)
    exposure.process_batch(h.landed(spark, [h.event("e1", "event_key_1", 100)]), 0, root, fx.mappings)
    assert states(spark, root) == {"IRIS.filter.event_key_1": "e1"}
    assert exposure.stored_snapshots(spark, root, fx.PARAMS).count() == 0
    exposure.process_batch(h.landed(spark, [h.observe("o1", 200)]), 1, root, fx.mappings)
    got = h.snapshot_dict(exposure.stored_snapshots(spark, root, fx.PARAMS))
    assert got[("o1", h.iso(200), "IRIS.filter.event_key_1")] == "e1"


def test_ingest_and_conversion(spark):
    rows, parts = batches(seed=7)
    root = scratch(spark, "convert")
    for part in parts:
        write_landing(h.landed(spark, part), f"{root}/bus")
        stream = read_landing_stream(spark, f"{root}/bus", fx.EVENT, files_per_trigger=2)
        convert.start_ingest(stream, f"{root}/landing", f"{root}/cp1", file_events=30, trigger=NOW).awaitTermination()
        convert.start_conversion(
            spark, f"{root}/landing", f"{root}/archive", f"{root}/cp2", fx.EVENT, trigger=NOW
        ).awaitTermination()
    assert read_landing(spark, f"{root}/landing", fx.EVENT).count() == len(rows)
    archive = store.read_archive(spark, f"{root}/archive", fx.EVENT)
    assert sorted(r.eventId for r in archive.select("eventId").collect()) == sorted(r[0] for r in rows)
    batch = store.archive_rows(h.landed(spark, rows)).select(archive.columns)
    assert archive.exceptAll(batch).count() == 0 and batch.exceptAll(archive).count() == 0


def test_state_without_stream_is_empty(spark):
    root = scratch(spark, "empty")
    exposure.prepare_tables(spark, root, fx.PARAMS)
    assert states(spark, root) == {}
    assert event_snapshot(h.bus(spark, [h.observe("o1", 1)])).count() == 1


SECOND = 10**6
HORIZON = 60


def fed(spark, root, parts, lateness=HORIZON, rules=None):
    exposure.prepare_tables(spark, root, fx.PARAMS)
    for batch_id, part in enumerate(parts):
        exposure.process_batch(h.landed(spark, part), batch_id, root, rules, lateness)


def archived(spark, root, rows):
    store.write_archive(store.archive_rows(h.landed(spark, rows)), f"{root}/archive", mode="overwrite")
    return store.read_archive(spark, f"{root}/archive", fx.EVENT)


@pytest.mark.parametrize("order", [[0, 1, 2, 3, 4], [3, 2, 4, 1, 0], [2, 3, 0, 1, 4]])
def test_late_observe_event_is_answered_from_the_archive(spark, order):
    rows = [h.event(f"c{t}", "c", t * SECOND, t) for t in (0, 100, 500, 510)] + [h.observe("o50", 50 * SECOND)]
    root = scratch(spark, "late-observe")
    fed(spark, root, [[rows[i]] for i in order])
    exposure.reconcile(spark, root, archived(spark, root, rows), fx.PARAMS)
    got = h.snapshot_dict(exposure.stored_snapshots(spark, root, fx.PARAMS))
    assert got == h.brute_force_snapshot(rows)
    assert got[("o50", h.iso(50 * SECOND), "IRIS.filter.c")] == "c0"


def test_a_late_observe_event_is_not_answered_before(spark):
    root = scratch(spark, "not-yet")
    early = [h.event("c0", "c", 0), h.event("c100", "c", 100 * SECOND), h.event("c500", "c", 500 * SECOND)]
    fed(spark, root, [early, [h.event("c900", "c", 900 * SECOND)], [h.observe("o50", 50 * SECOND), h.observe("o899", 899 * SECOND)]])
    stored = exposure.stored_snapshots(spark, root, fx.PARAMS)
    assert {r.obs_event_id for r in stored.collect()} == {"o899"}
    assert [r.eventId for r in exposure.stored_rejects(spark, root).collect()] == ["o50"]


@pytest.mark.parametrize("seed", [21, 22])
def test_reconciled_answers_equal_batch_with_a_short_lateness(spark, seed):
    """Events over 40 minutes in any order, a lateness of one minute, reconciled twice and once more without need."""
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        at = rng.randrange(2400) * SECOND
        if i % 6 == 5:
            rows.append(h.observe(f"o{i}", at, f"2020A-001-123-{rng.choice(['IRIS', 'WFOS'])}-IMG-SCI0-{i:04d}"))
        else:
            rows.append(h.event(f"e{i}", f"event_key_{rng.choice([1, 3, 5])}", at, i, "ESW.filter"))
    root = scratch(spark, "reconciled")
    exposure.prepare_tables(spark, root, fx.PARAMS)
    seen = []
    for batch_id in range(4):
        part = rows[batch_id * 30 : batch_id * 30 + 30]
        seen += part
        exposure.process_batch(h.landed(spark, part), batch_id, root, fx.mappings, HORIZON)
        if batch_id in (1, 3):
            archive = archived(spark, root, seen)
            assert exposure.reconcile(spark, root, archive, fx.PARAMS, fx.mappings) > 0
            assert exposure.reconcile(spark, root, archive, fx.PARAMS, fx.mappings) == 0
            got = h.snapshot_dict(exposure.stored_snapshots(spark, root, fx.PARAMS))
            assert got == h.brute_force_snapshot(seen)
    bus = h.bus(spark, rows)
    observes = observe_events(bus)
    values = keyword_extract(observes, event_snapshot(bus, observes=observes), fx.mappings(spark))
    stored = exposure.stored_keyword_values(spark, root).select(values.columns)
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, values.collect()))


def test_lookup_reads_few_days_and_channels(spark):
    day = 86400 * SECOND
    rows = [h.event("old", "rare", 0), h.event("mid", "slow", 12 * day)]
    rows += [h.event(f"e{i}", "often", i * day + 5) for i in range(25)]
    rows += [h.observe("o20", 20 * day + 7), h.observe("o3", 3 * day + 4)]
    root = scratch(spark, "lookup")
    archive = archived(spark, root, rows)
    found = lookup.archive_snapshot(archive, observe_events(h.bus(spark, rows)), lookback_days=(1, 10))
    assert h.snapshot_dict(found) == h.brute_force_snapshot(rows)
    spans = lookup.day_spans([date(2024, 1, 20), date(2024, 1, 4), date(2024, 1, 5)], 1)
    assert spans == [(date(2024, 1, 3), date(2024, 1, 5)), (date(2024, 1, 19), date(2024, 1, 20))]
    files = {r[0] for r in lookup.in_spans(archive, spans).select(F.input_file_name()).collect()}
    assert {f.partition("day=")[2].partition("/")[0] for f in files} == {"3", "4", "5", "19", "20"}


def test_state_folds_old_batches_and_keeps_what_readers_hold(spark):
    root = scratch(spark, "generations")
    exposure.prepare_tables(spark, root, fx.PARAMS)
    held = None
    for i in range(8):
        part = [h.event(f"e{i}-{c}", f"event_key_{c}", i * 50 * SECOND, i) for c in ([1, 2, 3] if i == 0 else [1])]
        exposure.process_batch(h.landed(spark, part), i, root, None, HORIZON)
        if i == 3:
            held = exposure.read_state(spark, root, fx.PARAMS)  # planned now, read after later batches
            want = {"IRIS.filter.event_key_1": "e3-1", "IRIS.filter.event_key_2": "e0-2", "IRIS.filter.event_key_3": "e0-3"}
    assert {r.event_key: r.eventId for r in held.collect()} == want
    assert states(spark, root) == want | {"IRIS.filter.event_key_1": "e7-1"}
    newest = generations.read_generation(spark, root)
    assert len(newest.recent) == 2  # the others are older than the lateness
    written = {f.partition("/bucket")[0] for f in newest.base.values()}
    assert len(written) > 1  # buckets without new events stay where an earlier batch wrote them
    last = files.names(spark, f"{root}/{generations.BASE}")[-1]
    assert len(files.names(spark, f"{root}/{generations.BASE}/{last}")) == 1  # one channel, one bucket


def test_generations_that_nobody_needs_go(spark, monkeypatch):
    root = scratch(spark, "forgotten")
    exposure.prepare_tables(spark, root, fx.PARAMS)
    monkeypatch.setattr(generations.finish, "__defaults__", (2,))
    for i in range(6):
        part = [h.event(f"e{i}", f"event_key_{i % 2}", i * 50 * SECOND, i)]
        exposure.process_batch(h.landed(spark, part), i, root, None, 10)
    assert len(files.names(spark, f"{root}/{generations.GENERATIONS}")) == 2
    assert len(files.names(spark, f"{root}/{generations.RECENT}")) <= 3
    assert states(spark, root) == {"IRIS.filter.event_key_0": "e4", "IRIS.filter.event_key_1": "e5"}


def test_an_attempt_that_failed_leaves_the_state_as_it_was(spark):
    root = scratch(spark, "failed")
    fed(spark, root, [[h.event("e1", "c", SECOND)]])
    generations.begin(spark, root, 1)  # a batch that wrote events but no pointer
    h.landed(spark, [h.event("x", "c", 2 * SECOND)]).write.parquet(f"{root}/{generations.RECENT}/{files.numbered(1, 0)}-lost")
    assert states(spark, root) == {"IRIS.filter.c": "e1"}
    exposure.process_batch(h.landed(spark, [h.event("e2", "c", 2 * SECOND)]), 1, root)
    assert states(spark, root) == {"IRIS.filter.c": "e2"}


def converted(spark, root):
    archive = store.read_archive(spark, f"{root}/archive", fx.EVENT)
    return archive, spark.read.parquet(convert.quarantine_of(f"{root}/archive"))


def test_every_landed_row_is_archived_or_quarantined(spark):
    rows, _ = batches(seed=9, n=60)
    root = scratch(spark, "torn")
    write_landing(h.landed(spark, rows), f"{root}/landing")
    torn = '{"eventId":"torn","source":"IRIS.filter","eventName":"c","eventTime":"2024-01-01T00:'
    nameless = '{"eventId":"nameless","eventTime":"2024-01-01T00:00:00Z"}'
    given = spark.createDataFrame([(torn,), (nameless,), ("no json at all",)], "value string")
    given.coalesce(1).write.mode("append").text(f"{root}/landing")
    convert.start_conversion(
        spark, f"{root}/landing", f"{root}/archive", f"{root}/cp", fx.EVENT, delete_consumed=True, trigger=NOW
    ).awaitTermination()
    archive, bad = converted(spark, root)
    assert sorted(r.eventId for r in archive.select("eventId").collect()) == sorted(r[0] for r in rows)
    assert sorted((r.reason, r.line) for r in bad.collect() if r.reason == landing.TORN) == sorted(
        [(landing.TORN, torn), (landing.TORN, "no json at all")]
    )
    assert [r.eventId for r in bad.collect() if r.reason == landing.NO_CHANNEL] == ["nameless"]
    assert archive.filter("source is null or eventName is null or eventId is null").isEmpty()
    both = read_landing(spark, f"{root}/landing", fx.EVENT, corrupt=True)
    assert landing.landed_events(both).count() + landing.quarantined(both).count() == both.count()


def test_a_hot_channel_is_written_by_several_tasks(spark):
    rows = [h.event(f"h{i:05d}", "hot", i * 1000, i) for i in range(900)]
    rows += [h.event(f"c{i}", f"cold_{i % 5}", i, i) for i in range(100)]
    random.Random(4).shuffle(rows)
    root = scratch(spark, "hot")
    write_landing(h.landed(spark, rows), f"{root}/landing")
    convert.start_conversion(
        spark, f"{root}/landing", f"{root}/archive", f"{root}/cp", fx.EVENT, trigger=NOW, target_rows=150
    ).awaitTermination()
    archive, _ = converted(spark, root)
    layout = {r.eventName: r for r in store.file_layout(archive).collect()}
    assert layout["hot"].n_rows == 900 and layout["hot"].n_files >= 5
    assert all(r.n_files == 1 for name, r in layout.items() if name != "hot")
    assert all(r.n_unordered == 0 for r in layout.values())


def test_a_batch_is_archived_once_however_often_it_is_tried(spark, monkeypatch):
    rows = [h.event(f"e{i}", f"c{i % 3}", i) for i in range(30)]
    root = scratch(spark, "tried")
    write_landing(h.landed(spark, rows), f"{root}/landing")
    given = read_landing(spark, f"{root}/landing", fx.EVENT, corrupt=True)
    move, moved = files.move, []

    def failing(session, source, target):
        if len(moved) == 2:
            raise OSError("lost")
        moved.append(target)
        move(session, source, target)

    monkeypatch.setattr(files, "move", failing)
    with pytest.raises(OSError, match="lost"):
        convert.convert_batch(given, 0, f"{root}/archive")
    monkeypatch.setattr(files, "move", move)
    for _ in range(2):
        convert.convert_batch(given, 0, f"{root}/archive")
    convert.convert_batch(given.limit(0), 1, f"{root}/archive")
    archive, _ = converted(spark, root)
    assert sorted(r.eventId for r in archive.collect()) == sorted(r[0] for r in rows)

"""Answers that were partial or wrong, and steps that outgrew a task."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from nightledger.llm.mixing import repeated
from nightledger.operators import layout
from nightledger.operators.snapshot import event_snapshot
from nightledger.plans import fixtures as fx
from nightledger.schema import EXPOSURE_END, EXPOSURE_START
from nightledger.session import scratch
from nightledger.sources import archive as store
from nightledger.streaming import exposure
from tests import helpers as h

SMALL = "/root/testdata/sf0.001"


def test_two_event_join_has_every_row_of_both_series(spark):
    got = entry.queries()["multi_event_join"](spark, SMALL)
    bus = fx.bus(spark, SMALL)
    left = bus.filter("source = 'IRIS.filter' AND eventName = 'event_key_1'")
    right = bus.filter("source = 'ESW.observe' AND eventName = 'ObserveEvent.ExposureStart'")
    want = left.select("eventTime").union(right.select("eventTime")).distinct()
    assert got.count() >= want.count() and want.join(got, "eventTime", "left_anti").isEmpty()


def test_observe_events_of_one_instant_see_each_other(spark):
    rows = [h.observe("o2", 10, name=EXPOSURE_START), h.observe("o1", 10, name=EXPOSURE_END), h.event("e", "event_key_1", 10)]
    rows += [h.observe("o3", 10, name=EXPOSURE_START), h.observe("o0", 9, name=EXPOSURE_START)]
    start, end = ("ESW.observe.ObserveEvent.Exposure" + kind for kind in ("Start", "End"))
    got = h.snapshot_dict(event_snapshot(h.bus(spark, rows), by_instant=True))
    want = {("o0", h.iso(9), start): "o0"}
    for o in ("o1", "o2", "o3"):
        want |= {(o, h.iso(10), start): "o3", (o, h.iso(10), end): "o1", (o, h.iso(10), "IRIS.filter.event_key_1"): "e"}
    assert got == want


def test_the_stream_answers_by_instant_whatever_comes_late(spark):
    second = 10**6
    on_time = [h.event("e1", "event_key_1", 100 * second), h.observe("o1", 110 * second, name=EXPOSURE_END)]
    late = [h.observe("l1", 5 * second), h.observe("l0", 5 * second, name=EXPOSURE_END), h.event("e0", "event_key_2", 4 * second)]
    last = [h.observe("o2", 110 * second), h.event("e2", "event_key_1", 300 * second)]
    root = scratch(spark, "instants")
    exposure.prepare_tables(spark, root, fx.PARAMS)
    for batch_id, part in enumerate([on_time, last, late]):
        exposure.process_batch(h.landed(spark, part), batch_id, root, None, 60, by_instant=True)
    rows = [*on_time, *last, *late]
    store.write_archive(store.archive_rows(h.landed(spark, rows)), f"{root}/archive")
    exposure.reconcile(spark, root, store.read_archive(spark, f"{root}/archive", fx.EVENT), fx.PARAMS, by_instant=True)
    got = h.snapshot_dict(exposure.stored_snapshots(spark, root, fx.PARAMS))
    assert got == h.snapshot_dict(event_snapshot(h.bus(spark, rows), by_instant=True))
    assert got[("o1", h.iso(110 * second), "ESW.observe.ObserveEvent.ExposureStart")] == "o2"
    assert got[("o1", h.iso(110 * second), "IRIS.filter.event_key_2")] == "e0"


def test_answers_newer_than_all_late_events_are_not_merged_again(spark, monkeypatch):
    """Only o1 can see the late event; the ten observe events after e2 hold something newer of its channel."""
    second, paths = 10**6, {}
    rows = [h.observe("o1", 100 * second), h.event("e2", "event_key_1", 200 * second)]
    rows += [h.observe(f"p{i}", (300 + i) * second) for i in range(10)]
    late = [h.event("e0", "event_key_1", 50 * second)]
    root = scratch(spark, "settled")
    exposure.prepare_tables(spark, root, fx.PARAMS)
    for batch_id, part in enumerate([rows, late]):
        exposure.process_batch(h.landed(spark, part), batch_id, root)
    store.write_archive(store.archive_rows(h.landed(spark, rows + late)), f"{root}/archive")

    def noted(session, name):
        paths[name] = scratch(session, name)
        return paths[name]

    monkeypatch.setattr(exposure, "scratch", noted)
    exposure.reconcile(spark, root, store.read_archive(spark, f"{root}/archive", fx.EVENT), fx.PARAMS)
    merged = spark.read.parquet(paths["reconciled"]).select("obs_event_id").distinct().collect()
    assert [r.obs_event_id for r in merged] == ["o1"]
    got = h.snapshot_dict(exposure.stored_snapshots(spark, root, fx.PARAMS))
    assert got == h.brute_force_snapshot(rows + late)


def test_a_task_of_the_layout_sorts_a_bounded_number_of_rows(spark, monkeypatch):
    rows = [h.event(f"e{i}", f"event_key_{i % 40}", i) for i in range(2000)]
    monkeypatch.setattr(layout, "TASK_ROWS", 100)
    monkeypatch.setattr(layout.tasks_for, "__defaults__", (100,))
    placed = layout.channel_layout(store.archive_rows(h.landed(spark, rows)))
    parts = placed.groupBy(F.spark_partition_id().alias("p")).agg(F.count_distinct("eventName").alias("n")).collect()
    assert placed.rdd.getNumPartitions() == 20 and max(p.n for p in parts) <= 10


def test_fragments_are_written_by_as_many_tasks_as_their_rows_need(spark, monkeypatch):
    monkeypatch.setattr(fx, "TASK_ROWS", 100)
    monkeypatch.setattr(fx, "_built", {})
    path = fx.fragments(spark, SMALL)
    files = spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct()
    tasks = files.select(F.regexp_extract("f", r"part-(\d+)", 1)).distinct().count()
    assert tasks > 2 and spark.read.parquet(path).count() == fx.bus(spark, SMALL).count()


def test_a_batch_written_twice_is_derived_once(spark, monkeypatch):
    derived = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            derived.add(batch.num_rows)
            yield batch

    values = spark.range(0, 1000, 1, 4).selectExpr("CAST(id AS STRING) AS exposure_id", "'K' AS keyword", "'v' AS value")
    values = values.mapInArrow(counted, values.schema)
    monkeypatch.setattr(fx, "extracted", lambda *_: values)
    assert entry.queries()["keyword_value_sink"](spark, SMALL).count() == 1000 and derived.value == 1000


def test_the_mix_shuffles_texts_once(spark):
    rows = [(i, f"some words of text {i}", "en", f"s{i % 3}", 10) for i in range(50)] + [(None, "a b", "en", None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.mode("overwrite").parquet(path := scratch(spark, "docs"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffles = [line for line in h.plan(repeated(spark.read.parquet(path))).splitlines() if "Exchange hashpartitioning" in line]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    by_key = [line for line in shuffles if "__source" in line and "__size" in line]
    assert len(by_key) == 1 and not any("hashpartitioning(doc_id" in line or "coalesce(doc_id" in line for line in shuffles)
    assert repeated(spark.read.parquet(path)).count() >= 51

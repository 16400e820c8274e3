"""Numbering, batching, hot table partitions and compaction."""

import random

import pytest
from pyspark.sql import functions as F

from nightledger.operators import filters, layout
from nightledger.plans.fixtures import EVENT
from nightledger.schema import CHANNEL_COLUMNS
from nightledger.session import scratch
from nightledger.sources import archive as store
from tests import helpers as h


def channel_rows(n=3000, hot=0.7):
    """Most rows belong to one channel of one day."""
    rng = random.Random(3)
    rows = []
    for i in range(n):
        name = "event_key_1" if rng.random() < hot else f"event_key_{2 + i % 5}"
        rows.append(h.event(f"e{i:05d}", name, rng.randrange(86400_000_000), i))
    return rows


def test_numbered_is_gapless_and_in_order(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(20), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "t int, id int").repartition(7)
    got = layout.numbered(df, ["t", "id"], tasks=6).collect()
    assert [(r.t, r.id) for r in sorted(got, key=lambda r: r.row_no)] == sorted(rows)
    assert sorted(r.row_no for r in got) == list(range(5000))


def test_numbered_spreads_one_hot_value(spark):
    df = spark.range(40000).select(F.lit(1).alias("t"), "id")
    placed = df.repartitionByRange(8, "t", "id").groupBy(F.spark_partition_id().alias("p")).count()
    assert placed.agg(F.max("count")).first()[0] < 12000
    assert layout.numbered(df, ["t", "id"], tasks=8).filter("row_no <> id").count() == 0


@pytest.mark.parametrize("max_rows,hot_rows", [(1, 1000), (7, 1000), (100, 1000), (1, 20), (7, 20), (100, 1)])
def test_chunks_close_on_count_or_window(spark, max_rows, hot_rows):
    rng = random.Random(2)
    times = [7_000_000, 8_500_000] * 60 + [rng.randrange(60_000_000) for _ in range(580)]
    rows = [h.event(f"e{i * 7919 % 700:05d}", "event_key_1", at) for i, at in enumerate(times)]
    df = store.archive_rows(h.landed(spark, rows)).select("eventId", "eventTimeStamp", "eventTime")
    chunks = layout.time_count_chunks(df, max_rows, "10 seconds", hot_rows)
    assert chunks.columns == [*df.columns, "window_start", "chunk"]
    got = chunks.collect()
    groups = {}
    for r in got:
        groups.setdefault((r.window_start, r.chunk), []).append((r.eventTime, r.eventId))
    assert len(got) == 700
    by_window = {}
    for (start, chunk), members in sorted(groups.items()):
        by_window.setdefault(start, []).append((chunk, sorted(members)))
    for chunks in by_window.values():
        assert [c for c, _ in chunks] == list(range(len(chunks)))
        assert all(len(m) == max_rows for _, m in chunks[:-1]) and len(chunks[-1][1]) <= max_rows
        ordered = [m for _, members in chunks for m in members]
        assert ordered == sorted(ordered)


def test_batch_stats_follow_from_instants(spark):
    rng = random.Random(4)
    times = [3_000_000] * 150 + [rng.randrange(30_000_000) for _ in range(400)]
    rows = [h.event(f"e{i:05d}", "event_key_1", at) for i, at in enumerate(times)]
    rows += [(f"n{i}", "IRIS.filter", "c", "no time", rows[0][4]) for i in range(25)]
    df = store.archive_rows(h.landed(spark, rows))
    chunks = layout.time_count_chunks(df, 7, "10 seconds").groupBy("window_start", "chunk")
    want = chunks.agg(F.count(F.lit(1)), F.min("eventTimeStamp"), F.max("eventTimeStamp")).collect()
    stats = layout.batch_stats(df, 7, "10 seconds")
    assert sorted(map(tuple, stats.collect()), key=repr) == sorted(map(tuple, want), key=repr)


def test_chunks_shuffle_rows_once_and_write_nothing(spark, monkeypatch):
    path = scratch(spark, "chunks")
    store.archive_rows(h.landed(spark, channel_rows(300))).write.parquet(path)
    monkeypatch.setattr(layout, "scratch", lambda *_: pytest.fail("a table was written"))
    events = spark.read.parquet(path)
    chunks = layout.time_count_chunks(events, 10, "1 hour")
    scans = [line for line in h.plan(chunks).splitlines() if "FileScan" in line]
    assert sum("paramSet" in line for line in scans) == 1
    assert sum("Exchange hashpartitioning(_at" in line for line in h.plan(chunks).splitlines()) == 1
    assert chunks.count() == 300
    scans = [line for line in h.plan(layout.batch_stats(events, 10, "1 hour")).splitlines() if "FileScan" in line]
    assert scans and all("ReadSchema: struct<eventTimeStamp:timestamp>" in line for line in scans)


def test_hot_partition_is_split_by_time(spark):
    rows = channel_rows()
    path = scratch(spark, "hot")
    store.write_archive(store.archive_rows(h.landed(spark, rows)), path, target_rows=500)
    archive = store.read_archive(spark, path, EVENT)
    layouts = {r.eventName: r for r in store.file_layout(archive).collect()}
    assert layouts["event_key_1"].n_files >= 4
    assert all(r.n_files == 1 for name, r in layouts.items() if name != "event_key_1")
    assert all(r.n_unordered == 0 for r in layouts.values())
    hot = archive.filter("eventName = 'event_key_1'").groupBy(F.col("_metadata.file_path").alias("f"))
    ends = hot.agg(F.min("eventTimeStamp").alias("lo"), F.max("eventTimeStamp").alias("hi"))
    spans = sorted((r.lo, r.hi) for r in ends.collect())
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert sorted(r.eventId for r in archive.select("eventId").collect()) == sorted(r[0] for r in rows)


def test_compaction_keeps_the_rows_and_is_idempotent(spark):
    base = scratch(spark, "compact")
    scattered = store.archive_rows(h.landed(spark, channel_rows(400))).repartition(4)
    store.write_archive(scattered, f"{base}/gen=0", layout=False)
    store.compact(spark, f"{base}/gen=0", f"{base}/gen=1", EVENT)
    store.compact(spark, f"{base}/gen=1", f"{base}/gen=2", EVENT)
    generations = [store.read_archive(spark, f"{base}/gen={g}", EVENT) for g in range(3)]
    assert generations[0].exceptAll(generations[1]).count() == 0
    assert generations[1].exceptAll(generations[0]).count() == 0
    assert generations[1].exceptAll(generations[2]).count() == 0
    for generation in generations[1:]:
        assert {(r.n_files, r.n_unordered) for r in store.file_layout(generation).collect()} == {(1, 0)}


def test_compaction_refuses_its_own_path(spark):
    with pytest.raises(ValueError):
        store.compact(spark, "/x/gen=0/", "/x/gen=0", EVENT)


def test_one_task_per_channel(spark):
    placed = layout.by_channel(store.archive_rows(h.landed(spark, channel_rows(500))))
    placed = placed.withColumn("task", F.spark_partition_id())
    tasks = placed.groupBy(*CHANNEL_COLUMNS).agg(F.count_distinct("task").alias("n"))
    assert tasks.filter("n > 1").count() == 0


@pytest.mark.parametrize("small", [0, 1000])
def test_first_events(spark, small):
    rows = [h.event(f"e{i:03d}", "c", (i * 37) % 50) for i in range(300)]
    got = filters.first_events(store.archive_rows(h.landed(spark, rows)), 70, small=small)
    want = sorted((r[3], r[0]) for r in rows)[:70]
    assert sorted((r.eventTime, r.eventId) for r in got.collect()) == want


def test_days_are_read_by_folder(spark):
    day = 86400_000_000
    rows = [h.event(f"e{i}", f"event_key_{i % 3}", i * day // 2) for i in range(8)]
    path = scratch(spark, "days")
    store.write_archive(store.archive_rows(h.landed(spark, rows)), path)
    whole = store.read_archive(spark, path, EVENT)

    def ids(days):
        picked = store.read_archive(spark, path, EVENT, days=days)
        assert picked.columns == whole.columns
        return sorted(r.eventId for r in picked.collect())

    assert ids([(2024, 1, 2)]) == ["e2", "e3"]
    assert ids([(2024, 1, 1), (2024, 1, 4)]) == ["e0", "e1", "e6", "e7"]
    assert ids([(2024, 1, 1), (2030, 1, 1)]) == ["e0", "e1"]
    assert ids([(2030, 1, 1)]) == []


def test_malformed_times_stay_in_the_archive(spark):
    good = h.event("e1", "event_key_1", 1)
    bad = ("e2", "IRIS.filter", "event_key_1", "not a time", good[4])
    path = scratch(spark, "malformed")
    store.write_archive(store.archive_rows(h.landed(spark, [good, bad, bad])), path, target_rows=1)
    rows = store.read_archive(spark, path, EVENT).collect()
    assert sorted((r.eventId, r.year) for r in rows if r.year) == [("e1", 2024)]
    assert [(r.eventId, r.eventTime, r.eventTimeStamp) for r in rows if not r.year] == [("e2", "not a time", None)] * 2

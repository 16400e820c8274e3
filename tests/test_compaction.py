"""Compaction beside a running conversion, and the two-event join with hot instants."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from nightledger.operators import filters
from nightledger.plans.fixtures import EVENT
from nightledger.session import scratch
from nightledger.sources import archive as store
from nightledger.sources import compaction, files
from tests import helpers as h

DAY = 86400_000_000


def append(spark, root, rows, tasks=3):
    landed = store.archive_rows(h.landed(spark, rows)).repartition(tasks, "eventId")
    store.write_archive(landed, compaction.incoming(root), layout=False)


def ids(rows):
    return sorted(r.eventId for r in rows.select("eventId").collect())


def days_of(n, day, start=0):
    return [h.event(f"d{day}-{start + i:04d}", f"event_key_{i % 3}", day * DAY + i * 1000, i) for i in range(n)]


def test_only_days_with_many_files_are_rewritten(spark):
    root = scratch(spark, "live")
    append(spark, root, days_of(60, 0))
    append(spark, root, days_of(60, 1), tasks=1)
    before = ids(compaction.read_live(spark, root, EVENT))
    done = compaction.compact_days(spark, root, EVENT)
    assert len(done) == 1
    assert ids(compaction.read_live(spark, root, EVENT)) == before and len(before) == 120
    assert compaction.compact_days(spark, root, EVENT) == []
    assert len(files.names(spark, f"{root}/live")) == 1
    layout = store.file_layout(store.read_archive(spark, f"{root}/generation=1", EVENT)).collect()
    assert {(r.n_files, r.n_unordered) for r in layout} == {(1, 0)}


def test_late_events_of_a_compacted_day_are_read_and_absorbed(spark):
    root = scratch(spark, "live")
    append(spark, root, days_of(60, 0))
    (day,) = compaction.compact_days(spark, root, EVENT)
    append(spark, root, days_of(9, 0, 500))
    append(spark, root, days_of(30, 2))
    everything = ids(compaction.read_live(spark, root, EVENT))
    assert len(everything) == 99
    assert len(ids(compaction.read_live(spark, root, EVENT, days=[day]))) == 69
    assert len(compaction.compact_days(spark, root, EVENT)) == 2
    assert ids(compaction.read_live(spark, root, EVENT)) == everything
    assert compaction.retire(spark, root) > 0
    assert ids(compaction.read_live(spark, root, EVENT)) == everything
    assert len(ids(compaction.read_live(spark, root, EVENT, days=[day]))) == 69
    assert compaction.read_live(spark, root, EVENT, days=[(1999, 1, 1)]).count() == 0


def test_a_failed_run_changes_nothing(spark, monkeypatch):
    root = scratch(spark, "live")
    append(spark, root, days_of(60, 0))
    before = ids(compaction.read_live(spark, root, EVENT))

    def broken(*_):
        raise OSError("no pointer")

    with monkeypatch.context() as patch:
        patch.setattr(files, "write_json", broken)
        with pytest.raises(OSError):
            compaction.compact_days(spark, root, EVENT)
    assert ids(compaction.read_live(spark, root, EVENT)) == before
    assert len(compaction.compact_days(spark, root, EVENT)) == 1
    assert ids(compaction.read_live(spark, root, EVENT)) == before


def test_files_follow_the_target_in_bytes(spark):
    root = scratch(spark, "live")
    rows = [h.event(f"e{i:05d}", "event_key_1", i * 1000, i) for i in range(4000)]
    append(spark, root, rows, tasks=12)
    compaction.compact_days(spark, root, EVENT, target_bytes=40_000)
    (layout,) = store.file_layout(store.read_archive(spark, f"{root}/generation=1", EVENT)).collect()
    assert layout.n_rows == 4000 and 1 < layout.n_files < 12 and layout.n_unordered == 0
    assert compaction.compact_days(spark, root, EVENT, target_bytes=40_000) == []


def test_an_absorbed_file_is_not_opened(spark):
    root = scratch(spark, "live")
    append(spark, root, days_of(60, 0))
    compaction.compact_days(spark, root, EVENT)
    rows = compaction.read_live(spark, root, EVENT)
    opened = rows.select(F.input_file_name().alias("f")).distinct().collect()
    assert all("/generation=1/" in r.f for r in opened)
    compaction.retire(spark, root)
    assert rows.count() == 60


def outer(left, right):
    got = Counter()
    for t, a in left:
        partners = [b for s, b in right if s == t and t is not None]
        got.update([(t, a, b) for b in partners] or [(t, a, None)])
    for t, b in right:
        if t is None or all(s != t for s, _ in left):
            got[(t, None, b)] += 1
    return got


@pytest.mark.parametrize("hot", [10, 10_000])
def test_two_event_join_with_hot_instants(spark, hot):
    left = [("t5", i) for i in range(60)] + [(f"t{i % 40}", i) for i in range(90)] + [("alone", 1)] * 30 + [(None, 7)] * 5
    right = [("t5", i % 4) for i in range(35)] + [(f"t{i}", i) for i in range(30, 50)] + [("other", i) for i in range(25)] + [(None, 8)] * 3
    a, b = spark.createDataFrame(left, "eventTime string, x int"), spark.createDataFrame(right, "eventTime string, x int")
    joined = filters.multi_event_join(a, b, hot)
    assert joined.columns == ["eventTime", "x", "x"]
    rows = [tuple(r) for r in joined.collect()]
    assert Counter(rows) == outer(left, right)
    times = [r[0] for r in rows]
    assert times == sorted(times, key=lambda t: (t is not None, t or ""))


def test_a_hot_instant_is_split(spark):
    left = spark.range(3000).select(F.when(F.col("id") < 1000, "t").otherwise(F.col("id").cast("string")).alias("eventTime"), F.lit(1).alias("a"))
    right = spark.range(60).select(F.lit("t").alias("eventTime"), F.lit(2).alias("b"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = filters.multi_event_join(left, right, 50).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in parts) == 1000 * 60 + 2000
    assert max(r["count"] for r in parts) < 62000 / 3

"""The as-of snapshot against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from nightledger.operators import keywords
from nightledger.operators import snapshot as sn
from nightledger.operators.keywords import asked_params, keyword_extract, keywords_from_bus
from nightledger.operators.state import latest_per_key
from nightledger.plans import fixtures as fx
from nightledger.schema import EXPOSURE_END, OBSERVE_EVENTS
from tests import helpers as h

MINUTE = 60_000_000


def random_rows(seed, n, channels, span, observes, hot=0.0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        channel = "event_key_0" if rng.random() < hot else f"event_key_{rng.randrange(channels)}"
        rows.append(h.event(f"e{i:05d}", channel, rng.randrange(span), i))
    for i in range(observes):
        name = rng.choice(OBSERVE_EVENTS)
        rows.append(h.observe(f"o{i:05d}", rng.randrange(span), f"2020A-001-123-IRIS-IMG-SCI0-{i:04d}", name))
    return rows


@pytest.mark.parametrize(
    "rows, cell_seconds",
    [
        (random_rows(1, 400, 7, 20 * MINUTE, 40), None),
        (random_rows(2, 400, 7, 20 * MINUTE, 40), 1),
        (random_rows(3, 400, 7, 20 * MINUTE, 40), 60),
        (random_rows(4, 600, 5, 40, 60), None),  # times collide: ties everywhere
        (random_rows(5, 600, 5, 40, 60), 1),
        (random_rows(6, 500, 9, 86400_000_000 * 25, 30), None),  # far apart: states are carried over many cells
        (random_rows(7, 500, 9, 86400_000_000 * 2, 30), 10),
        (random_rows(8, 900, 4, 5 * MINUTE, 200, hot=0.5), None),  # one channel has half of all rows
    ],
)
def test_snapshot_equals_brute_force(spark, rows, cell_seconds):
    got = h.snapshot_dict(sn.event_snapshot(h.bus(spark, rows), cell_seconds=cell_seconds))
    assert got == h.brute_force_snapshot(rows)


def test_snapshot_without_broadcasts_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sn, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = random_rows(12, 900, 4, 5 * MINUTE, 100, hot=0.5)
        df = sn.event_snapshot(h.bus(spark, rows))
        assert "BroadcastHashJoin" not in h.plan(df)
        assert h.snapshot_dict(df) == h.brute_force_snapshot(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_earlier_state_gives_the_observe_event_only(spark):
    rows = [h.observe("o1", 10), h.event("e1", "event_key_1", 11)]
    assert h.snapshot_dict(sn.event_snapshot(h.bus(spark, rows))) == {
        ("o1", h.iso(10), "ESW.observe.ObserveEvent.ExposureStart"): "o1"
    }


def test_event_at_the_observe_time_counts(spark):
    rows = [h.event("z9", "event_key_1", 10), h.observe("a1", 10)]
    got = h.snapshot_dict(sn.event_snapshot(h.bus(spark, rows)))
    assert got[("a1", h.iso(10), "IRIS.filter.event_key_1")] == "z9"


def test_no_observe_events(spark):
    assert sn.event_snapshot(h.bus(spark, [h.event("e1", "event_key_1", 1)])).count() == 0


def test_limited_to_keys_and_observes(spark):
    rows = random_rows(9, 300, 5, 20 * MINUTE, 30)
    keys = spark.createDataFrame([("IRIS.filter.event_key_1",)], "event_key string")
    bus = h.bus(spark, rows)
    ends = sn.observe_events(bus, [EXPOSURE_END])
    got = h.snapshot_dict(sn.event_snapshot(bus, keys=keys, observes=ends))
    ended = {r[0] for r in rows if r[2] == EXPOSURE_END}
    want = h.brute_force_snapshot(rows)
    assert got == {k: v for k, v in want.items() if k[0] in ended and k[2] == "IRIS.filter.event_key_1"}
    assert got


def test_malformed_times_take_no_part(spark):
    rows = [h.event("e1", "event_key_1", 5), h.observe("o1", 10)]
    rows.append(("e2", "IRIS.filter", "event_key_2", "not a time", rows[0][4]))
    got = h.snapshot_dict(sn.event_snapshot(h.bus(spark, rows)))
    assert sorted(got.values()) == ["e1", "o1"]


def test_observe_without_exposure_id(spark):
    df = sn.observe_events(h.bus(spark, [h.observe("o1", 1, exposure=None)]))
    assert [r.exposure_id for r in df.collect()] == [None]


def test_latest_per_key(spark):
    rows = random_rows(10, 500, 5, 50, 20)
    got = {r.event_key: r.eventId for r in latest_per_key(h.bus(spark, rows)).collect()}
    best = {}
    for r in rows:
        key = f"{r[1]}.{r[2]}"
        best[key] = max(best.get(key, ("", "")), (r[3], r[0]))
    assert got == {k: v[1] for k, v in best.items()}


def test_events_are_read_once_and_nothing_is_crossed(spark):
    rows = random_rows(11, 200, 5, 20 * MINUTE, 20)
    df = sn.event_snapshot(h.bus(spark, rows))
    df._jdf.collectToPython()
    final = h.plan(df).split("Initial Plan")[0]
    assert "ReusedExchange" in final
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition", "Python"):
        assert word not in final.replace("PythonRDD", "").replace("ExistingRDD", "")


def test_a_burst_and_a_long_quiet_span(spark):
    day = 86400 * 1_000_000
    burst = [h.observe(f"o{i}", 1_000_000 + i) for i in range(80)]
    rows = [h.event("e1", "event_key_1", 5), h.event("e2", "event_key_2", day), *burst]
    rows += [h.event("e3", "event_key_1", 20 * day), h.observe("late", 21 * day)]
    df = sn.event_snapshot(h.bus(spark, rows))
    assert h.snapshot_dict(df) == h.brute_force_snapshot(rows)


def test_states_are_carried_over_many_blocks(spark):
    """Half a million cells: each asked one gets the last state before it, by hand and by windows of a few hundred rows."""
    units, rng = 500_000, random.Random(13)
    ends = [("hot", at) for at in rng.sample(range(units), 3000)] + [("once", 70), ("last", units - 1)]
    asked = sorted(rng.sample(range(units), 400))
    table = spark.createDataFrame([(key, at, f"{key}-{at}") for key, at in ends], "event_key string, at long, v string")
    got = sn._carried(table, spark.createDataFrame([(a,) for a in asked], "at long"), units, ["v"], True)
    want = {}
    for key in ("hot", "once", "last"):
        own = sorted(at for k, at in ends if k == key)
        for a in asked:
            earlier = [at for at in own if at < a]
            if earlier:
                want[(key, a)] = f"{key}-{earlier[-1]}"
    rows = got.collect()
    assert {(r.event_key, r.at): r.v for r in rows} == want and len(rows) == len(want)


def test_windows_are_bounded_and_the_output_is_not_shuffled(spark):
    """Every window is over a cell or a block of cells, and rows per observe event are made after the last shuffle."""
    text = h.plan(sn.event_snapshot(h.bus(spark, random_rows(14, 300, 5, 20 * MINUTE, 200))))
    windows = [line.split("Window [")[1] for line in text.splitlines() if " Window [" in line]
    assert windows and all("cell#" in w or "block#" in w for w in windows)
    assert text.index("inline(") < text.index("Exchange")
    assert "SortAggregate" not in text


def test_only_asked_parameters_are_kept(spark):
    rules = spark.createDataFrame([("iris.filter.event_key_1", "other")], "event_key string, key_name string")
    rows = [h.event("e1", "event_key_1", 1, 7), h.event("e2", "event_key_2", 1, 7)]
    rows.append(("e3", "IRIS.filter", "event_key_1", h.iso(2), None))
    bus = h.bus(spark, rows)
    key = bus.filter("eventId = 'e1'").first().event_key
    kept = {r.eventId: r.paramSet for r in asked_params(bus, rules.withColumn("event_key", F.lit(key))).collect()}
    assert set(kept) == {"e1", "e3"}
    assert kept["e1"].IntKey == [] and kept["e3"] is None
    named = rules.select(F.lit(key).alias("event_key"), F.lit("temperature").alias("key_name"))
    kept = {r.eventId: r.paramSet for r in asked_params(bus, named).collect()}
    assert kept["e1"].IntKey[0]["values"] == [7]


def test_keywords_from_the_bus_equal_those_of_snapshots(spark, monkeypatch):
    rows = []
    for i, r in enumerate(random_rows(15, 300, 9, 20 * MINUTE, 40)):
        rows.append((r[0], "ESW.filter" if i % 2 and r[1] != "ESW.observe" else r[1], *r[2:]))
    bus, rules = h.bus(spark, rows), fx.mappings(spark)
    observes = sn.observe_events(bus)
    want = sorted(map(tuple, keyword_extract(observes, sn.event_snapshot(bus), rules).collect()))
    assert want and sorted(map(tuple, keywords_from_bus(bus, observes, rules).collect())) == want
    monkeypatch.setattr(keywords, "few_values", lambda *_: None)  # as with mappings too large to broadcast
    assert sorted(map(tuple, keywords_from_bus(bus, observes, rules).collect())) == want


def test_no_parameter_set_is_shuffled_for_keywords(spark):
    bus = h.bus(spark, random_rows(16, 100, 5, 20 * MINUTE, 20))
    df = keywords_from_bus(bus, sn.observe_events(bus), fx.mappings(spark))
    text = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    shuffled = [part for part in text.split("\n\n") if "Exchange" in part.split("\n")[0]]
    assert shuffled and not any("paramSet" in part for part in shuffled)
    assert "SortAggregate" not in text

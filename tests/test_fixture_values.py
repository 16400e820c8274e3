"""Counts worked out beforehand for observe events at every fiftieth event of sf0.01."""

import pytest
from pyspark.sql import functions as F

from nightledger.operators import headers, keywords, snapshot, state
from nightledger.plans import fixtures as fx
from nightledger.schema import EXPOSURE_END, EXPOSURE_START
from nightledger.sources.archive import archive_rows
from nightledger.sources.landing import with_key
from tests.oracle import ROOT

SF_DIR = f"{ROOT}/sf0.01"


@pytest.fixture(scope="module")
def bus(spark):
    rows = fx.events(spark, SF_DIR)
    number = F.floor(F.col("event_id") / 100).cast("bigint")
    name = F.when(F.col("event_id") % 100 == 0, EXPOSURE_START).otherwise(EXPOSURE_END)
    instrument = F.when(number % 2 == 0, "IRIS").otherwise("WFOS")
    observe = fx.as_observes(rows.filter(F.col("event_id") % 50 == 0), name, number, instrument)
    return with_key(archive_rows(fx.as_telemetry(rows).unionByName(observe))).persist()


@pytest.fixture(scope="module")
def snap(bus):
    return snapshot.event_snapshot(bus).persist()


@pytest.fixture(scope="module")
def values(spark, bus, snap):
    return keywords.keyword_extract(snapshot.observe_events(bus), snap, fx.mappings(spark)).persist()


def test_snapshot_rows(snap):
    assert snap.count() == 4380
    assert snap.filter("source <> 'ESW.observe'").count() == 3981


def test_merged_mappings(spark):
    counts = {(r.subsystem, r.kind): r["count"] for r in fx.mappings(spark).groupBy("subsystem", "kind").count().collect()}
    assert counts == {
        ("IRIS", "constant"): 2,
        ("IRIS", "complex"): 10,
        ("WFOS", "constant"): 3,
        ("WFOS", "complex"): 10,
    }


def test_keyword_rows(values):
    assert values.count() == 847


def test_one_exposure(values):
    rows = values.filter("exposure_id = '2020A-001-123-IRIS-IMG-SCI0-0002'").collect()
    assert {r.keyword: r.value for r in rows} == {
        "CONST1": "constant-value-other",
        "CONST2": "constant-value-2",
        "INTENS": "54",
        "POWER": "0.56",
        "POWERC": "0.560",
        "STATE": "click",
        "TEMP": "89",
        "TEMP2": "58",
    }


def test_rejects(spark, bus, snap):
    rejects = keywords.keyword_rejects(snapshot.observe_events(bus), snap, fx.mappings(spark))
    counts = {(r.keyword, r.reason): r["count"] for r in rejects.groupBy("keyword", "reason").count().collect()}
    assert counts == {
        ("BADATTR", "ATTRIBUTE_UNSUPPORTED"): 100,
        ("NOPARAM", "PARAM_MISSING"): 100,
        ("NOEVENT", "EVENT_MISSING"): 100,
        ("TEMP9", "INDEX_OUT_OF_RANGE"): 99,
        ("INTENS", "EVENT_MISSING"): 1,
        ("TEMP", "EVENT_MISSING"): 1,
        ("TEMP2", "EVENT_MISSING"): 1,
        ("TEMP9", "EVENT_MISSING"): 1,
    }


def test_headers(spark, values):
    exposures = values.select("exposure_id")
    rows = headers.fits_headers(exposures, fx.header_lists(spark), state.keyword_last_wins(values)).collect()
    assert len(rows) == 100
    header = {r.exposure_id: r.header for r in rows}["2020A-001-123-IRIS-IMG-SCI0-0002"]
    lines = header.split("\n")
    assert [line[:8].strip() for line in lines] == ["TEMP", "CONST2", "CONST1", "POWER", "STATE"]
    assert {len(line) for line in lines} == {80}

"""Small event tables for the tests."""

from __future__ import annotations

from pyspark.sql import Row
from pyspark.sql import functions as F

from nightledger.plans.fixtures import EVENT
from nightledger.schema import EXPOSURE_START
from nightledger.sources.archive import archive_rows
from nightledger.sources.landing import with_key


def event(event_id, channel, at, value=None, source="IRIS.filter"):
    """A telemetry event of one int parameter; ``at`` is microseconds since 2024."""
    ints = [Row(keyName="temperature", units="NoUnits", values=[value])]
    return (str(event_id), source, channel, iso(at), Row(IntKey=ints, DoubleKey=None, StringKey=None))


def observe(event_id, at, exposure="2020A-001-123-IRIS-IMG-SCI0-0001", name=EXPOSURE_START):
    strings = None if exposure is None else [Row(keyName="exposureId", units="NoUnits", values=[exposure])]
    return (str(event_id), "ESW.observe", name, iso(at), Row(IntKey=None, DoubleKey=None, StringKey=strings))


def iso(micros):
    seconds, fraction = divmod(micros, 1_000_000)
    days, seconds = divmod(seconds, 86400)
    clock = f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}.{fraction:06d}Z"
    return f"2024-01-{days + 1:02d}T{clock}"


def landed(spark, rows):
    return spark.createDataFrame(rows, EVENT)


def bus(spark, rows):
    return with_key(archive_rows(landed(spark, rows)))


def brute_force_snapshot(rows, names=("ObserveEvent.ExposureStart", "ObserveEvent.ExposureEnd")):
    """{(observe id, observe time, channel key): event id} by comparing every observe event with every event."""

    def order(r):
        return (r[3], r[2] in names, r[0])

    out = {}
    for o in rows:
        if o[2] not in names:
            continue
        best = {}
        for r in rows:
            key = f"{r[1]}.{r[2]}"
            if order(r) <= order(o) and (key not in best or order(best[key]) < order(r)):
                best[key] = r
        out.update({(o[0], o[3], key): r[0] for key, r in best.items()})
    return out


def snapshot_dict(df):
    rows = df.select("obs_event_id", F.date_format("obs_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), "event_key", "eventId")
    collected = rows.collect()
    found = {(r[0], r[1], r[2]): r[3] for r in collected}
    assert len(found) == len(collected)
    return found


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()

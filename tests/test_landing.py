"""Landing files, schema inference, permissive decoding, configuration and quality rows."""

import gzip
import json
import os

import pytest
from pyspark.sql import types as T

from nightledger.operators import headers, mapping, quality
from nightledger.plans import fixtures as fx
from nightledger.plans.fixtures import EVENT
from nightledger.session import scratch
from nightledger.sources import archive as store
from nightledger.sources import config, landing, tables
from nightledger.streaming import convert
from tests import helpers as h


def payload(i, **extra):
    ints = [{"keyName": "temperature", "units": "C", "values": [i, i + 1]}]
    return {
        "eventId": str(i),
        "source": "IRIS.filter",
        "eventName": "n",
        "eventTime": "2024-01-01T00:00:00Z",
        "paramSet": {"IntKey": ints},
        **extra,
    }


def local(path):
    os.makedirs(path.removeprefix("file:"))
    return path.removeprefix("file:")


def test_arrays_and_lines_become_rows(spark):
    path = scratch(spark, "arrays")
    folder = local(path)
    with gzip.open(f"{folder}/a.json.gz", "wt") as f:
        f.write(json.dumps([payload(i) for i in range(10)]))
    with gzip.open(f"{folder}/b.json.gz", "wt") as f:
        f.write("\n".join(json.dumps(payload(i)) for i in range(10, 15)))
    rows = landing.read_landing(spark, path, EVENT).collect()
    assert sorted(int(r.eventId) for r in rows) == list(range(15))
    assert all(r.paramSet.IntKey[0]["values"][1] == int(r.eventId) + 1 for r in rows)


def test_inferred_schema_round_trips(spark):
    path = scratch(spark, "infer")
    with open(f"{local(path)}/a.json", "w") as f:
        json.dump([payload(1)], f, indent=1)
    schema = landing.infer_schema(spark, path, multi_line=True)
    assert T.StructType.fromJson(json.loads(schema.json())) == schema
    assert ("paramSet.IntKey[].values[]", "bigint") in landing.field_types(schema)


def test_files_hold_a_bounded_number_of_events(spark):
    path = scratch(spark, "bounded")
    landing.write_landing(h.landed(spark, [h.event(i, "c", i) for i in range(100)]).coalesce(1), path, file_events=30)
    files = [f for f in os.listdir(path.removeprefix("file:")) if f.endswith(".json.gz")]
    assert len(files) == 4
    assert landing.read_landing(spark, path, EVENT).count() == 100


def test_array_files_hold_one_batch_each(spark):
    from nightledger.sources.archive import archive_rows

    path = scratch(spark, "array-files")
    events = [h.event(f"e{i:03d}", "c", i * 100_000) for i in range(100)]
    landing.write_landing_arrays(archive_rows(h.landed(spark, events)), path, 15, "2 seconds")
    folder = path.removeprefix("file:")
    batches = []
    for name in os.listdir(folder):
        if name.endswith(".gz"):
            with gzip.open(f"{folder}/{name}", "rt") as f:
                batches.append([e["eventId"] for e in json.loads(f.read())])
    assert sorted(map(len, batches)) == [5] * 5 + [15] * 5
    assert all(b == sorted(b) for b in batches)
    assert sorted(r.eventId for r in landing.read_landing(spark, path, EVENT).collect()) == [e[0] for e in events]


def test_bad_payloads_become_flagged_rows(spark):
    good = json.dumps(payload(1))
    cases = [(1, good), (2, good[:-4]), (3, "nope"), (4, ""), (5, None), (6, "{}"), (7, json.dumps(payload(7, extra=1)))]
    rows = landing.decode_payloads(spark.createDataFrame(cases, "n int, p string"), "p", EVENT).collect()
    assert {r.n for r in rows if not r.is_bad} == {1, 7}
    assert len(rows) == 7 and all(r.eventId is None for r in rows if r.is_bad)


def test_merge_allows_missing_fields(spark):
    a = spark.createDataFrame([("1", "x")], "eventId string, source string")
    b = spark.createDataFrame([("2",)], "eventId string")
    got = [(r.eventId, r.source) for r in landing.merge_streams(a, b, b).collect()]
    assert sorted(got, key=str) == [("1", "x"), ("2", None), ("2", None)]


def test_mapping_files_of_every_format(spark):
    rows = [("IRIS", 0, "K", None, "S", "esw.a.b", "p[1]", None), ("IRIS", 0, "C", "v", None, None, None, None)]
    from nightledger.schema import MAPPING_SCHEMA

    df = spark.createDataFrame(rows, MAPPING_SCHEMA)
    for fmt in ("json", "csv", "parquet"):
        path = scratch(spark, fmt)
        df.write.format(fmt).option("header", True).save(path)
        assert sorted(map(tuple, config.read_mappings(spark, path, fmt).collect()), key=str) == sorted(rows, key=str)


def test_mapping_files_name_their_subsystem(spark):
    from nightledger.schema import MAPPING_SCHEMA, SUBSYSTEMS

    folder = scratch(spark, "mapping-files")
    base = local(folder)
    for name in ("IRIS-keyword-mappings.json", "my-wfos.json", "other.json"):
        with open(f"{base}/{name}", "w") as f:
            f.write(json.dumps({"keyword": name, "layer": 0, "value": "v"}))
    rows = config.read_mapping_files(spark, [folder], SUBSYSTEMS)
    assert rows.columns == spark.createDataFrame([], MAPPING_SCHEMA).columns
    assert sorted((r.subsystem, r.keyword) for r in rows.collect()) == [
        ("IRIS", "IRIS-keyword-mappings.json"),
        ("WFOS", "my-wfos.json"),
    ]


def test_override_replaces_whole_subsystems(spark):
    base = spark.createDataFrame([("IRIS", "A"), ("IRIS", "B"), ("WFOS", "A")], "subsystem string, keyword string")
    external = spark.createDataFrame([("IRIS", "C")], "subsystem string, keyword string")
    rows = mapping.override_subsystems(base, external).collect()
    assert sorted(map(tuple, rows)) == [("IRIS", "C"), ("WFOS", "A")]


def test_header_lists(spark):
    own = spark.createDataFrame(
        [("IRIS", "G", ["A", "B"]), ("WFOS", "none", ["C"])], "subsystem string, group string, keywords array<string>"
    )
    shared = spark.createDataFrame([("G", ["X", "Y"])], "group string, keywords array<string>")
    rows = mapping.concat_header_lists(own, shared)
    assert sorted(map(tuple, rows.collect())) == [
        ("IRIS", 0, "X"),
        ("IRIS", 1, "Y"),
        ("IRIS", 2, "A"),
        ("IRIS", 3, "B"),
        ("WFOS", 0, "C"),
    ]
    known = spark.createDataFrame([("iris",)], "name string")
    assert mapping.known_subsystems(own, known).count() == 1
    joined = {r.subsystem: r.keywords for r in headers.ordered_header_list(rows).collect()}
    assert joined == {"IRIS": "X,Y,A,B", "WFOS": "C"}


def test_header_subset_keeps_request_order_and_first_position(spark):
    values = spark.createDataFrame(
        [("x", "A", "1"), ("x", "B", "it's"), ("x", "C", "3")], "exposure_id string, keyword string, value string"
    )
    requests = spark.createDataFrame([("x", "C,A,C,Z,B"), ("y", "A")], "exposure_id string, keywords string")
    got = {r.exposure_id: r.header for r in headers.header_subset(requests, values).collect()}
    assert [line[:8].strip() for line in got["x"].split("\n")] == ["C", "A", "B"]
    assert "'it''s   '" in got["x"]
    assert got["y"] == ""


def test_keyword_lookups(spark):
    values = spark.createDataFrame([("x", "A", "1"), ("y", "A", "2")], "exposure_id string, keyword string, value string")
    assert tables.keyword_values_of(values, ["x"]).count() == 1
    requests = spark.createDataFrame([("y",), ("y",), ("z",)], "exposure_id string")
    assert [r.value for r in tables.keyword_values_for(values, requests).collect()] == ["2"]


def test_quality_rows(spark):
    rows = spark.createDataFrame(
        [(1, "x" * 50, "ok"), (2, "x" * 51, None), (3, None, "é" * 50)], "id int, exposure_id string, value string"
    )
    got = quality.row_constraints(rows, ["id"], ["exposure_id", "value"]).collect()
    assert sorted(map(tuple, got)) == [
        (2, "exposure_id", "TOO_LONG"),
        (2, "value", "NULL"),
        (3, "exposure_id", "NULL"),
    ]


def test_schemas_are_stored_as_versions_and_drift_is_shown(spark, tmp_path):
    folder = str(tmp_path / "schemas")
    with pytest.raises(FileNotFoundError):
        landing.stored_schema(spark, folder)
    old = T.StructType.fromDDL("a int, b string, c array<struct<x: bigint, y: double>>, gone string")
    new = T.StructType.fromDDL("a bigint, b int, c array<struct<x: int, y: double, z: string>>")
    first = landing.store_schema(spark, folder, old)
    landing.store_schema(spark, folder, new)
    assert landing.stored_schema(spark, folder) == new
    assert landing.stored_schema(spark, folder, first) == old
    got = {r.path: (r.stored, r.found, r.drift) for r in landing.schema_drift(spark, old, new).collect()}
    assert got == {
        "a": ("int", "bigint", landing.WIDENED),
        "b": ("string", "int", landing.CONFLICTING),
        "c[].x": ("bigint", "int", landing.NARROWED),
        "c[].z": (None, "string", landing.ADDED),
        "gone": ("string", None, landing.MISSING),
    }
    assert landing.schema_drift(spark, old, old).isEmpty()


def test_conversion_from_a_stored_schema(spark, tmp_path):
    rows = [h.event(f"e{i}", "c", i, i) for i in range(5)]
    landing.write_landing(h.landed(spark, rows), str(tmp_path / "landing"))
    folder = str(tmp_path / "schemas")
    landing.store_schema(spark, folder, fx.EVENT)
    convert.start_conversion(
        spark, str(tmp_path / "landing"), str(tmp_path / "archive"), str(tmp_path / "cp"), folder, trigger={"availableNow": True}
    ).awaitTermination()
    archive = store.read_archive(spark, str(tmp_path / "archive"), fx.EVENT)
    assert sorted(r.eventId for r in archive.collect()) == [f"e{i}" for i in range(5)]

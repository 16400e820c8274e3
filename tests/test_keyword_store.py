"""The folded store of keyword values: rows kept, few files per lookup, batches written again, nothing lost to readers."""

import math

import pytest
from pyspark.sql import functions as F

from nightledger.session import scratch
from nightledger.sources import files, keyword_store

SCHEMA = "exposure_id string, keyword string, value string"


def batch(spark, i, exposures=9):
    rows = [(f"exp-{e}", f"KEY{k}", f"{i}-{e}-{k}") for e in range(exposures) for k in range(3)]
    return spark.createDataFrame([*rows, rows[0], (None, "KEY", str(i)), ("exp-null", None, None)], SCHEMA)


def shown(rows):
    return sorted((tuple(r) for r in rows.select("batch_id", "exposure_id", "keyword", "value").collect()), key=repr)


def wanted(spark, ids, keep=lambda e: True):
    return sorted(((i, *r) for i in ids for r in batch(spark, i).collect() if keep(r.exposure_id)), key=repr)


def test_folds_keep_all_rows_and_lookups_open_one_bucket_a_run(spark):
    root = scratch(spark, "kv")
    for i in range(9):
        keyword_store.append(batch(spark, i), root, i)
        keyword_store.fold(spark, root, buckets=8)
    state = keyword_store._state(spark, root)
    assert state["through"] == 7 and sum(r["batches"] for r in state["runs"]) == 8
    sizes = [r["batches"] for r in state["runs"]]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:])) and len(sizes) <= 1 + math.log2(8)
    assert shown(keyword_store.read(spark, root)) == wanted(spark, range(9))
    found = keyword_store.lookup(spark, root, ["exp-3"])
    assert shown(found) == wanted(spark, range(9), lambda e: e == "exp-3")
    folders = {f.rpartition("/")[0] for f in found.inputFiles() if "/runs/" in f}
    assert len(folders) == len(sizes)
    assert {f.rpartition("/")[0].rpartition("/")[2] for f in found.inputFiles() if "/batches/" in f} == {"batch_id=8"}
    assert shown(keyword_store.lookup(spark, root, ["exp-none"])) == []


def test_a_hot_exposure_is_cut_over_tasks_and_files(spark):
    root = scratch(spark, "kv")
    hot = spark.range(40_000).select(F.lit("hot").alias("exposure_id"), F.concat(F.lit("K"), "id").alias("keyword"), F.lit("v").alias("value"))
    keyword_store.append(hot, root, 0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few
    try:
        (run,) = keyword_store.fold(spark, root, left_open=0)["runs"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = keyword_store._run(spark, root, run).groupBy(F.input_file_name().alias("f")).agg(
        F.count(F.lit(1)).alias("n"), F.min("keyword").alias("low"), F.max("keyword").alias("high")
    ).orderBy("low").collect()
    assert len(run["held"]) == 1 and len(parts) > 1 and max(p.n for p in parts) < 15_000
    assert all(a.high < b.low for a, b in zip(parts, parts[1:]))


def test_open_batches_are_replaced_and_folded_ones_refused(spark):
    root = scratch(spark, "kv")
    with pytest.raises(ValueError):
        keyword_store.read(spark, root)
    assert keyword_store.fold(spark, root) is None
    keyword_store.append(batch(spark, 0), root, 0)
    keyword_store.append(batch(spark, 5), root, 1)
    keyword_store.append(batch(spark, 1).limit(0), root, 1)
    assert shown(keyword_store.read(spark, root)) == wanted(spark, [0])
    keyword_store.append(batch(spark, 1), root, 1)
    keyword_store.fold(spark, root)
    assert keyword_store.fold(spark, root) is None
    with pytest.raises(ValueError):
        keyword_store.append(batch(spark, 0), root, 0)
    keyword_store.append(batch(spark, 1).limit(0), root, 1)
    keyword_store.fold(spark, root, left_open=0)
    assert shown(keyword_store.read(spark, root)) == wanted(spark, [0])
    only_empty = scratch(spark, "kv")
    keyword_store.append(batch(spark, 0).limit(0), only_empty, 0)
    keyword_store.fold(spark, only_empty, left_open=0)
    assert shown(keyword_store.read(spark, only_empty)) == [] == shown(keyword_store.lookup(spark, only_empty, ["exp-1"]))


def test_readers_of_the_last_pointers_lose_no_file(spark):
    root = scratch(spark, "kv")
    for i in range(4):
        keyword_store.append(batch(spark, i), root, i)
        keyword_store.fold(spark, root, left_open=0, buckets=2 + i)
        if i == 2:
            reader = keyword_store.read(spark, root)
    gone = keyword_store.retire(spark, root)
    assert {g for g in gone if g.startswith("batches")} == {f"batches/batch_id={i}" for i in range(3)}
    assert len(files.names(spark, f"{root}/live")) == 2
    assert shown(reader) == wanted(spark, range(3))
    assert shown(keyword_store.read(spark, root)) == wanted(spark, range(4))
    assert keyword_store.retire(spark, root, kept=1) and shown(keyword_store.read(spark, root)) == wanted(spark, range(4))


def test_requests_by_bucket_or_by_join(spark):
    root = scratch(spark, "kv")
    keyword_store.append(batch(spark, 0), root, 0)
    keyword_store.append(batch(spark, 1), root, 1)
    keyword_store.fold(spark, root)
    requests = spark.createDataFrame([("exp-1",), ("exp-1",), ("exp-7",), ("none",), (None,)], "exposure_id string")
    for few in (1, 1000):
        found = keyword_store.lookup_for(spark, root, requests, few)
        assert shown(found) == wanted(spark, [0, 1], lambda e: e in ("exp-1", "exp-7"))
    nobody = keyword_store.lookup_for(spark, root, requests.filter("exposure_id is null"))
    assert shown(nobody) == []

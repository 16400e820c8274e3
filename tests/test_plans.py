"""What reaches the scan, and what must not appear in a plan."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from nightledger.operators import filters, sizes
from nightledger.plans import fixtures as fx
from tests.helpers import plan
from tests.oracle import ROOT

SF_DIR = f"{ROOT}/sf0.001"

# Columns of the archive and the streaming twins are read back from tables; these build their whole plan lazily.
LAZY = [
    "filter_event_pattern",
    "single_event_query",
    "multi_event_join",
    "event_snapshot",
    "keyword_extract",
    "keyword_rejects",
    "fits_header",
    "header_subset",
    "latest_per_key",
    "params_long",
    "mapping_layer_merge",
    "mapping_override",
    "header_coverage",
    "empty_result_check",
]


@pytest.mark.parametrize("name", LAZY)
def test_no_python_and_no_cross_join(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    for word in ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct"):
        assert word not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_channel_query_prunes_partitions_columns_and_row_groups(spark):
    df = filters.single_event_query(
        fx.archive(spark, SF_DIR),
        "IRIS.filter",
        "event_key_1",
        "IntKey",
        "temperature",
        low="2024-01-19T10:20:30.5Z",
        high="2024-01-19T12:20:30Z",
        day=(2024, 1, 19),
    )
    scan = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pruned = next(line for line in scan.splitlines() if line.startswith("PartitionFilters"))
    for column in ("year", "month", "day", "source", "eventName"):
        assert f"({column}" in pruned or f"{column}#" in pruned
    assert "GreaterThanOrEqual(eventTimeStamp" in scan
    schema = next(line for line in scan.splitlines() if line.startswith("ReadSchema"))
    assert "IntKey" in schema and "DoubleKey" not in schema and "StringKey" not in schema and "eventId" not in schema


def test_mapped_channels_prune_partitions(spark):
    wanted = spark.createDataFrame([("ESW.filter.event_key_1",)], "event_key string")
    kept = sizes.keep_values(fx.stored_bus(spark, SF_DIR), "event_key", wanted)
    files = {r[0] for r in kept.select(F.input_file_name()).distinct().collect()}
    assert files and all("source=ESW.filter/eventName=event_key_1" in f for f in files)


def test_sizes_decide(spark):
    rows = spark.range(50).withColumn("k", F.col("id") % 7)
    wanted = spark.range(5).withColumnRenamed("id", "k")
    for limit in (1, 100):
        assert sizes.keep_values(rows, "k", wanted, max_values=limit).count() == rows.filter("k < 5").count()
    assert "broadcast" in sizes.broadcast_if_small(wanted)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in sizes.broadcast_if_small(wanted, 2)._jdf.queryExecution().logical().toString().lower()


def test_few_requests_narrow_the_scan(spark):
    rows = spark.range(50).withColumn("k", F.col("id") % 7)
    wanted = spark.createDataFrame([(1,), (1,), (None,)], "k bigint")
    assert sizes.narrow_to(rows, "k", wanted).count() == rows.filter("k = 1").count()
    assert sizes.narrow_to(rows, "k", wanted, max_rows=2).count() == 50
    assert sizes.narrow_to(rows, "k", wanted.filter("k > 5")).count() == 0

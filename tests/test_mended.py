"""Odd values that used to give a wrong or missing answer."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from nightledger.functions.formats import right_ascension, three_decimals
from nightledger.functions.params import has_name
from nightledger.operators import filters, headers, layout, mapping, quality
from nightledger.sources import archive as store
from nightledger.sources import landing, tables
from tests import helpers as h


def test_null_angles_have_no_text(spark):
    row = spark.range(1).select(F.lit(None).cast("double").alias("a")).select(three_decimals(F.col("a")), right_ascension(F.col("a")))
    assert tuple(row.first()) == (None, None)


def test_ties_of_a_layer_do_not_depend_on_the_order_of_rows(spark):
    fields = ["subsystem", "keyword", "layer", *mapping.MAPPING_FIELDS]
    rows = [("A", "K", 1, value, None, None, None, None) for value in ("x", "y")]
    schema = ", ".join(f"{f} {'int' if f == 'layer' else 'string'}" for f in fields)
    got = [mapping.merge_layers(spark.createDataFrame(r, schema)).first()["value"] for r in (rows, rows[::-1])]
    assert got == ["y", "y"]


def test_names_of_white_space_are_blank(spark):
    names = spark.createDataFrame([("a",), (" ",), ("\t",), (" ",), (None,)], "n string")
    assert [r[0] for r in names.select(has_name(F.col("n"))).collect()] == [True, False, False, False, False]


def test_events_without_a_time_stay_in_their_batch(spark):
    rows = [h.event(i, "c", i) for i in range(5)]
    rows.append(("9", "IRIS.filter", "c", "no time", rows[0][4]))
    got = layout.time_count_chunks(store.archive_rows(h.landed(spark, rows)), 2, "2 seconds").collect()
    assert sorted((r.eventId, r.window_start is None, r.chunk) for r in got)[-1] == ("9", True, 0)
    assert len(got) == 6


def test_a_time_range_prunes_days(spark, tmp_path):
    path = str(tmp_path / "archive")
    store.write_archive(store.archive_rows(h.landed(spark, [h.event(i, "c", i * 86_400_000_000) for i in range(4)])), path)
    rows = filters.in_time_range(store.read_archive(spark, path), "2024-01-02T00:00:00Z", "2024-01-03T00:00:00Z")
    filtered = h.plan(rows).split("PartitionFilters: ")[1].split("]")[0]
    assert all(name in filtered for name in ("year", "month", "day")) and rows.count() == 2


def test_a_batch_of_no_rows_replaces_the_rows_before(spark, tmp_path):
    path = str(tmp_path / "values")
    rows = spark.createDataFrame([Row(exposure_id="e", keyword="k", value="v")])
    tables.write_keyword_values(rows, path, 1)
    tables.write_keyword_values(rows, path, 2)
    tables.write_keyword_values(rows.limit(0), path, 1)
    assert [r.batch_id for r in tables.read_keyword_values(spark, path).collect()] == [2]


def test_coverage_is_compared_without_case(spark):
    listed = spark.createDataFrame([("IRIS", "KEY")], "subsystem string, keyword string")
    mapped = spark.createDataFrame([("iris", "Key")], "subsystem string, keyword string")
    assert quality.header_coverage(listed, mapped).isEmpty()


def test_values_that_fit_no_card_are_listed(spark):
    lists = spark.createDataFrame([("IRIS", i, k) for i, k in enumerate(["OK", "LONGVAL", "MUCHTOOLONG", "NONE"])], "subsystem string, pos int, keyword string")
    exposure = "2020A-001-123-IRIS-IMG-SCI0-0001"
    given = [("OK", "v"), ("LONGVAL", "x" * 69), ("MUCHTOOLONG", "v")]
    values = spark.createDataFrame([(exposure, *pair) for pair in given], "exposure_id string, keyword string, value string")
    wanted = headers.exposure_keywords(values.select("exposure_id"), lists)
    got = sorted((r.keyword, r.reason) for r in headers.header_rejects(wanted, values).collect())
    assert got == [("LONGVAL", "VALUE_TOO_LONG"), ("MUCHTOOLONG", "KEYWORD_TOO_LONG")]
    assert len(headers.fits_headers(values.select("exposure_id"), lists, values).first()["header"]) == 80


def test_torn_lines_keep_their_text(spark, tmp_path):
    path = str(tmp_path / "landing")
    whole = '{"eventId":"1","source":"IRIS.filter","eventName":"c","eventTime":"2024-01-01T00:00:00Z"}'
    torn = '{"eventId":"2","source":"IRIS.fil'
    spark.createDataFrame([(whole,), (torn,)], "value string").coalesce(1).write.text(path)
    assert [r.line for r in landing.torn_lines(spark, path).collect()] == [torn]

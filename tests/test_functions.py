"""Column functions on hand-written edge values."""

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from nightledger.functions import cards, formats, keys, params, times
from nightledger.operators import filters, keywords
from nightledger.schema import COORD_TYPE, event_schema, param_set
from nightledger.sources import config
from tests import helpers as h


def one(spark, column, **values):
    """The column over one row of the given string values."""
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(1).alias("_"))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text, name, index",
    [
        ("temp", "temp", 0),
        ("temp[3]", "temp", 3),
        ("a[1][2]", "a[1]", 2),
        ("a[1]b", "a[1]b", 0),
        ("a[x]", "a[x]", 0),
        ("[4]", "", 4),
        ("", "", 0),
        ("a[99999999999]", "a", None),
        (None, None, None),
    ],
)
def test_param_path(spark, text, name, index):
    path = F.col("p").cast("string")
    assert one(spark, params.path_name(path), p=text) == name
    assert one(spark, params.path_index(path), p=text) == index


@pytest.mark.parametrize("text, named", [("a", True), (" ", False), ("", False), (None, False)])
def test_blank_name(spark, text, named):
    assert one(spark, params.has_name(F.col("p").cast("string")), p=text) is named


@pytest.mark.parametrize(
    "text, subsystem",
    [
        ("2020A-001-123-IRIS-IMG-SCI0-0001", "IRIS"),
        ("2020A-001-123-iris-IMG-SCI0-0001", "IRIS"),
        ("a-b-c-IRIS-e-f", None),
        ("a-b-c-IRIS-e-f-g-h", None),
        ("a-b-c-IRIS-e-f-g-", "IRIS"),
        ("a-b-c-IRIS-e-f--", None),
        ("", None),
        (None, None),
    ],
)
def test_exposure_subsystem(spark, text, subsystem):
    assert one(spark, keys.exposure_subsystem(F.col("e").cast("string")), e=text) == subsystem


def test_channel_key(spark):
    assert one(spark, keys.normal_key(F.col("k")), k="esw.filter.Event_1") == "ESW.filter.Event_1"
    assert one(spark, keys.event_key(F.lit("iris.a.b"), F.lit("n"))) == "IRIS.a.b.n"
    assert one(spark, keys.event_key(F.lit("iris"), F.lit("n"))) == "IRIS.n"


@pytest.mark.parametrize(
    "pattern, matches",
    [("*.*.*", True), ("*.*.event_1", True), ("IRIS.*", True), ("IRIS.f", False), ("*event%1", False), ("*event_2", False)],
)
def test_glob(spark, pattern, matches):
    assert one(spark, keys.glob_like(F.lit("IRIS.f.event_1"), pattern)) is matches


def test_glob_underscore_is_literal(spark):
    assert one(spark, keys.glob_like(F.lit("IRIS.f.eventX1"), "*event_1")) is False


def test_patterns_give_each_event_once(spark):
    bus = h.bus(spark, [h.event("e1", "event_key_1", 1), h.event("e2", "other", 1)])
    got = filters.by_key_pattern(bus, ["*", "IRIS.*", "*_1"]).groupBy("eventId").count().collect()
    assert {r.eventId: r["count"] for r in got} == {"e1": 1, "e2": 1}
    assert [r.eventId for r in filters.by_event_name(bus, ["other"]).collect()] == ["e2"]


@pytest.mark.parametrize(
    "text, micro, iso",
    [
        ("2021-03-19T07:08:39Z", "2021-03-19T07:08:39.000000Z", "2021-03-19T07:08:39Z"),
        ("2021-03-19T07:08:39.500Z", "2021-03-19T07:08:39.500000Z", "2021-03-19T07:08:39.500Z"),
        ("2021-03-19T07:08:39.066140Z", "2021-03-19T07:08:39.066140Z", "2021-03-19T07:08:39.066140Z"),
        ("2021-03-19T07:08:39.123456789Z", "2021-03-19T07:08:39.123456Z", "2021-03-19T07:08:39.123456Z"),
        ("nope", None, None),
    ],
)
def test_times(spark, text, micro, iso):
    at = times.event_timestamp(F.col("t"))
    assert one(spark, times.micro_text(at), t=text) == micro
    assert one(spark, times.iso_instant(at), t=text) == iso


def test_range_includes_both_ends_and_compares_instants(spark):
    rows = [h.event(f"e{i}", "c", at) for i, at in enumerate([999_999, 1_000_000, 1_500_000, 2_000_000, 2_000_001])]
    archive = h.bus(spark, rows)
    got = filters.in_time_range(archive, "2024-01-01T00:00:01Z", "2024-01-01T00:00:02Z").collect()
    assert sorted(r.eventId for r in got) == ["e1", "e2", "e3"]


@pytest.mark.parametrize(
    "degrees, text",
    [
        (0.0, "00:00:00.000"),
        (183.30895833333333, "12:13:14.150"),
        (359.9999999, "00:00:00.000"),
        (359.99999, "23:59:59.998"),
        (14.99999999, "01:00:00.000"),
        (-15.0, "23:00:00.000"),
    ],
)
def test_right_ascension(spark, degrees, text):
    assert one(spark, formats.right_ascension(F.lit(degrees))) == text


def coord(kind, **parts):
    given = {"kind": F.lit(kind), **{k: F.lit(v) for k, v in parts.items()}}
    return F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in COORD_TYPE.fields])


def test_coordinates(spark):
    altaz = coord("AltAzCoord", az=301.0, alt=42.4995)
    eq = coord("EqCoord", ra=183.30895833333333, dec=-30.5)

    def text(value, attribute):
        return one(spark, formats.choose_format(formats.coord_formats(value), F.lit(attribute)))

    assert text(altaz, "azD") == "301.000"
    assert text(altaz, "altD") == "42.500"
    assert float(text(altaz, "az")) == math.radians(301.0)
    assert float(text(eq, "dec")) == math.radians(-30.5)
    assert text(eq, "ra") == "12:13:14.150"
    assert text(eq, "az") is None and text(altaz, "ra") is None
    assert text(eq, None) is None and text(altaz, "default") is None
    assert text(coord("CometCoord", ra=1.0), None) is not None


def test_doubles(spark):
    assert one(spark, formats.double_formats(F.lit(42.4995))["custom"]) == "42.500"
    assert one(spark, formats.double_formats(F.lit(1e7))["default"]) == "1.0E7"


ALL_TYPES = {
    "BooleanKey": ([True, False], "true"),
    "ByteKey": ([10, 20], "10"),
    "CharKey": (["A", "B"], "A"),
    "ShortKey": ([30, 40], "30"),
    "LongKey": ([50, 60], "50"),
    "IntKey": ([70, 80], "70"),
    "FloatKey": ([90.0, 100.0], "90.0"),
    "DoubleKey": ([110.0, 120.0], "110.0"),
    "UTCTimeKey": (["1970-01-01T00:00:00Z", "2017-09-04T19:00:00.123456789Z"], "1970-01-01T00:00:00Z"),
    "TAITimeKey": (["1970-01-01T00:00:00Z", "2017-09-04T19:00:00.123456789Z"], "1970-01-01T00:00:00Z"),
    "ByteArrayKey": ([[1, 2]], "[1,2]"),
    "ShortArrayKey": ([[3, 4]], "[3,4]"),
    "LongArrayKey": ([[5, 6]], "[5,6]"),
    "IntArrayKey": ([[7, 8]], "[7,8]"),
    "FloatArrayKey": ([[9.0, 10.0]], "[9.0,10.0]"),
    "DoubleArrayKey": ([[11.0, 12.0]], "[11.0,12.0]"),
    "ByteMatrixKey": ([[[1, 2], [3, 4]]], "[[1,2],[3,4]]"),
    "ShortMatrixKey": ([[[4, 5], [6, 7]]], "[[4,5],[6,7]]"),
    "LongMatrixKey": ([[[8, 9], [10, 11]]], "[[8,9],[10,11]]"),
    "IntMatrixKey": ([[[12, 13], [14, 15]]], "[[12,13],[14,15]]"),
    "FloatMatrixKey": ([[[16.0, 17.0]]], "[[16.0,17.0]]"),
    "DoubleMatrixKey": ([[[20.0, 21.0]]], "[[20.0,21.0]]"),
    "ChoiceKey": (["First", "Second"], "First"),
    "StringKey": (["abc"], "abc"),
}


@pytest.fixture(scope="module")
def all_types(spark):
    """One event with a parameter of every type, named after it."""
    coords = [Row(kind="AltAzCoord", tag="BASE", ra=None, dec=None, az=301.0, alt=42.5)]
    given = {**{k: v[0] for k, v in ALL_TYPES.items()}, "CoordKey": coords}
    sets = Row(*param_set().fieldNames())(
        *[[Row(keyName=f"{k}123", units=None, values=given[k])] for k in param_set().fieldNames()]
    )
    return spark.createDataFrame([("1", "IRIS.filter", "all", "2024-01-01T00:00:00Z", sets)], event_schema())


def test_long_table_of_all_types(all_types):
    got = {r.type: (r.key_name, r["values"][0]) for r in keywords.params_long(all_types).collect()}
    assert len(got) == 25
    assert {k: got[k] for k in ALL_TYPES} == {k: (f"{k}123", v[1]) for k, v in ALL_TYPES.items()}


def test_all_types_survive_landing(spark, all_types):
    from nightledger.session import scratch
    from nightledger.sources import landing

    path = scratch(spark, "all-types")
    landing.write_landing(all_types, path)
    assert landing.read_landing(spark, path).collect() == all_types.collect()


def test_lookup(spark, all_types):
    cases = [
        ("IntKey123", 1, None, "80", None),
        ("DoubleKey123", 1, "custom", "120.000", None),
        ("UTCTimeKey123", 1, "iso", "2017-09-04T19:00:00.123456Z", None),
        ("UTCTimeKey123", 1, None, "2017-09-04T19:00:00.123456789Z", None),
        ("CoordKey123", 0, "azD", "301.000", None),
        ("CoordKey123", 0, None, None, params.ATTRIBUTE_UNSUPPORTED),
        ("CoordKey123", 0, "nope", None, params.ATTRIBUTE_UNSUPPORTED),
        ("IntKey123", 0, "custom", None, params.ATTRIBUTE_UNSUPPORTED),
        ("IntKey123", 2, None, None, params.INDEX_OUT_OF_RANGE),
        ("IntKey123", None, None, None, params.INDEX_OUT_OF_RANGE),
        ("missing", 0, None, None, params.PARAM_MISSING),
        (" ", 0, None, None, params.PARAM_MISSING),
        (None, 0, None, None, params.PARAM_MISSING),
    ]
    asked = spark.createDataFrame(cases, "n string, i int, a string, value string, reason string")
    found = params.lookup(F.col("paramSet"), param_set(), F.col("n"), F.col("i"), F.col("a"))
    rows = asked.crossJoin(all_types).select("n", "i", "a", found.alias("f")).collect()
    got = {(r.n, r.i, r.a): (r.f.value, r.f.reason) for r in rows}
    assert got == {c[:3]: c[3:] for c in cases}


def test_first_value_of_empty_list(spark):
    schema = "p array<struct<keyName:string,units:string,values:array<int>>>"
    df = spark.createDataFrame([([Row("a", None, [])],), ([],), (None,)], schema)
    assert [r.x for r in df.select(params.value_at(F.col("p"), "a").alias("x")).collect()] == [None] * 3


@pytest.mark.parametrize("value", ["", "abcd", "exactly8", "x" * 16, "x" * 50, "x" * 68, "it's", "'" * 34])
def test_card_is_80_wide_and_holds_the_value(spark, value):
    card = one(spark, cards.fits_card(F.lit("TEMP"), F.col("v")), v=value)
    assert len(card) == 80
    assert card.startswith("TEMP    = '")
    quoted = card[11:].rstrip()[:-1]
    assert quoted == value.replace("'", "''").ljust(8)


def test_card_rejects(spark):
    def reason(keyword, value):
        return one(spark, cards.card_reason(F.lit(keyword), F.lit(value).cast("string")))

    assert reason("NINECHARS", "v") == "KEYWORD_TOO_LONG"
    assert reason("TEMP", "x" * 69) == "VALUE_TOO_LONG"
    assert reason("TEMP", "'" * 35) == "VALUE_TOO_LONG"
    assert reason("TEMP", None) == "MISSING"
    assert one(spark, cards.fits_card(F.lit("TEMP"), F.lit("x" * 69))) is None


def test_constant_over_complex_stays_constant(spark):
    from nightledger.operators.mapping import merge_layers
    from nightledger.schema import MAPPING_SCHEMA

    layers = spark.createDataFrame(
        [
            ("IRIS", 0, "K", "v", None, None, None, None),
            ("IRIS", 2, "K", None, "ObserveEvent.ExposureEnd", "esw.a.b", "p[2]", "x"),
            ("IRIS", 0, "L", None, "S", "esw.a.b", "p", None),
            ("IRIS", 1, "L", None, None, "esw.a.c", None, None),
        ],
        MAPPING_SCHEMA,
    )
    rows = {r.keyword: r for r in config.classify_mappings(merge_layers(layers)).collect()}
    assert (rows["K"].kind, rows["K"].value, rows["K"].obs_event_name) == ("constant", "v", "ObserveEvent.ExposureStart")
    assert (rows["L"].kind, rows["L"].event_key, rows["L"].key_name) == ("complex", "esw.a.c", "p")

"""Configuration as tables: keyword mappings, header lists and observe-event names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightledger.functions.params import path_index, path_name
from nightledger.schema import EXPOSURE_START, HEADER_SCHEMA, MAPPING_SCHEMA

CONSTANT = "constant"
COMPLEX = "complex"


def read_mappings(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Mapping rows of all layers from JSON, CSV or Parquet."""
    reader = spark.read.schema(MAPPING_SCHEMA).format(fmt)
    return (reader.option("header", True) if fmt == "csv" else reader).load(path)


def read_mapping_files(spark: SparkSession, paths: list[str], names: list[str], fmt: str = "json") -> DataFrame:
    """Mapping rows of files kept per subsystem: the subsystem is the first name found in the file's name.

    Files that name no known subsystem are left out.
    """
    file_name = F.lower("_metadata.file_name")
    named = F.coalesce(*[F.when(file_name.contains(name.lower()), F.lit(name)) for name in names])
    rows = spark.read.schema(MAPPING_SCHEMA).format(fmt)
    rows = (rows.option("header", True) if fmt == "csv" else rows).load(paths)
    return rows.withColumn("subsystem", named).filter(F.col("subsystem").isNotNull())


def classify_mappings(mappings: DataFrame) -> DataFrame:
    """Mark each mapping constant (it has a value) or complex, and parse its parameter path.

    A constant belongs to the exposure-start event whatever else the row says.
    """
    constant = F.col("value").isNotNull()
    complex_only = {name: F.when(~constant, F.col(name)) for name in ("event_key", "param_key", "attribute")}
    return (
        mappings.withColumn("kind", F.when(constant, CONSTANT).otherwise(COMPLEX))
        .withColumn("obs_event_name", F.when(constant, EXPOSURE_START).otherwise(F.col("obs_event_name")))
        .withColumns(complex_only)
        .withColumn("key_name", path_name(F.col("param_key")))
        .withColumn("key_index", path_index(F.col("param_key")))
    )


def read_header_lists(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Header lists stored one entry per subsystem, ``(subsystem, keywords array)``, as ordered rows."""
    return header_rows(spark.read.schema("subsystem string, keywords array<string>").format(fmt).load(path))


def header_rows(lists: DataFrame) -> DataFrame:
    """``(subsystem, pos, keyword)`` of header lists held as arrays."""
    return lists.select("subsystem", F.posexplode("keywords").alias("pos", "keyword"))


def header_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Header lists that are stored as ordered rows."""
    return spark.read.schema(HEADER_SCHEMA).format(fmt).load(path)


def observe_names(spark: SparkSession, names: list[str]) -> DataFrame:
    """The set of observe-event names that trigger a snapshot."""
    return spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("event_name")).distinct()

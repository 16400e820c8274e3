"""Queries over mapping and header configuration that grows with the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightledger.operators import mapping, quality
from nightledger.plans import fixtures as fx
from nightledger.plans.fixtures import sql
from nightledger.plans.registry import query
from nightledger.sources import config

_FIELDS = ["subsystem", "keyword", "value", "obs_event_name", "event_key", "param_key", "attribute"]


@query(
    "keyword_mapping_source",
    sql(
        """SELECT layer, subsystem, keyword, value, CASE WHEN value IS NULL THEN 'complex' ELSE 'constant' END AS kind,
        CASE WHEN value IS NULL THEN obs_event_name ELSE 'ObserveEvent.ExposureStart' END AS obs_event_name,
        CASE WHEN value IS NULL THEN event_key END AS event_key, CASE WHEN value IS NULL THEN param_key END AS param_key,
        CASE WHEN value IS NULL THEN attribute END AS attribute FROM order_layers""",
        "order_layers",
    ),
)
def keyword_mapping_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping rows stored as JSON, read and classified."""
    path = fx.built(spark, sf_dir, "mappings", lambda p: fx.order_layers(spark, sf_dir).write.json(p))
    return config.classify_mappings(config.read_mappings(spark, path)).select("layer", "kind", *_FIELDS)


@query("mapping_layer_merge", sql(f"SELECT {', '.join(_FIELDS)} FROM order_merged", "order_merged"))
def mapping_layer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.merge_layers(fx.order_layers(spark, sf_dir)).select(*_FIELDS)


@query(
    "mapping_override",
    sql(
        """SELECT layer, subsystem, keyword, event_key FROM order_layers WHERE event_key IS NOT NULL OR subsystem NOT IN
        (SELECT subsystem FROM order_layers WHERE event_key IS NOT NULL)""",
        "order_layers",
    ),
)
def mapping_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that name a channel count as external; they replace all other rows of their instrument."""
    layers = fx.order_layers(spark, sf_dir)
    external = layers.filter(F.col("event_key").isNotNull())
    base = layers.filter(F.col("event_key").isNull())
    return mapping.override_subsystems(base, external).select("layer", "subsystem", "keyword", "event_key")


@query(
    "known_subsystem_filter",
    sql(
        """SELECT layer, subsystem, keyword FROM order_layers WHERE subsystem IN
        (SELECT 'INST' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'MACHINERY')""",
        "order_layers",
    ),
)
def known_subsystem_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruments of one market segment are known; entries and the dimension spell names in different cases."""
    machinery = fx.table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "MACHINERY")
    known = machinery.select(F.concat(F.lit("Inst"), F.col("c_custkey").cast("string")).alias("name"))
    name = F.when(F.col("layer") % 2 == 0, F.lower("subsystem")).otherwise(F.col("subsystem"))
    entries = fx.order_layers(spark, sf_dir).withColumn("subsystem", name)
    return mapping.known_subsystems(entries, known).select("layer", "subsystem", "keyword")


@query(
    "header_coverage",
    sql(
        """SELECT DISTINCT subsystem, keyword, 'UNMAPPED' AS problem FROM customer_headers
        WHERE (subsystem, keyword) NOT IN (SELECT (subsystem, keyword) FROM order_layers)
        UNION ALL SELECT DISTINCT subsystem, keyword, 'UNUSED' FROM order_layers
        WHERE (subsystem, keyword) NOT IN (SELECT (subsystem, keyword) FROM customer_headers)""",
        "customer_headers",
        "order_layers",
    ),
)
def header_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.header_coverage(fx.customer_headers(spark, sf_dir), fx.order_layers(spark, sf_dir))

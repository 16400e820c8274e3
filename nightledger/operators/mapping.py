"""Merging and filtering keyword mappings and header lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightledger.functions.keys import exposure_subsystem
from nightledger.operators.sizes import broadcast_if_small

MAPPING_FIELDS = ["value", "obs_event_name", "event_key", "param_key", "attribute"]


def merge_layers(layers: DataFrame) -> DataFrame:
    """One row per subsystem and keyword: each field from the latest layer that sets it.

    If a layer sets a field twice, the larger value counts, whatever the order of the rows.
    """
    fields = [F.max(F.when(F.col(name).isNotNull(), F.struct("layer", name)))[name].alias(name) for name in MAPPING_FIELDS]
    return layers.groupBy("subsystem", "keyword").agg(*fields)


def override_subsystems(base: DataFrame, external: DataFrame) -> DataFrame:
    """External rows replace everything of the subsystems they name; other subsystems keep their rows."""
    named = broadcast_if_small(external.select("subsystem").distinct())
    return base.join(named, "subsystem", "left_anti").unionByName(external)


def known_subsystems(entries: DataFrame, subsystems: DataFrame, column: str = "subsystem") -> DataFrame:
    """Entries whose name is a known subsystem, compared without case and returned in upper case."""
    known = subsystems.select(F.upper("name").alias(column)).distinct()
    return entries.withColumn(column, F.upper(column)).join(broadcast_if_small(known), column, "left_semi")


def mapping_for(mappings: DataFrame, observes: DataFrame) -> DataFrame:
    """The mapping rows of each observe event's subsystem that apply to its name."""
    asked = observes.withColumn("subsystem", exposure_subsystem(F.col("exposure_id")))
    rules = mappings.withColumn("subsystem", F.upper("subsystem"))
    return asked.join(broadcast_if_small(rules), ["subsystem", "obs_event_name"])


def concat_header_lists(own: DataFrame, shared: DataFrame) -> DataFrame:
    """``(subsystem, pos, keyword)``: the list of the subsystem's group, then its own.

    ``own`` is ``(subsystem, group, keywords)``, ``shared`` is ``(group, keywords)``; a group without a list adds
    nothing.
    """
    groups = shared.select("group", F.col("keywords").alias("shared_keywords"))
    both = F.concat(F.coalesce("shared_keywords", F.array().cast("array<string>")), "keywords")
    return own.join(groups, "group", "left").select("subsystem", F.posexplode(both).alias("pos", "keyword"))

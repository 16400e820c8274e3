"""Headers of whole exposure tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightledger.functions.cards import card_reason, fits_card
from nightledger.functions.keys import exposure_subsystem
from nightledger.operators.sizes import broadcast_if_small, narrow_to


def _with_values(wanted: DataFrame, values: DataFrame) -> DataFrame:
    return wanted.join(values.select("exposure_id", "keyword", "value"), ["exposure_id", "keyword"], "left")


def header_rejects(wanted: DataFrame, values: DataFrame) -> DataFrame:
    """``(exposure_id, keyword, reason)`` of values that do not fit a card and so are missing from the header.

    ``wanted`` comes from ``exposure_keywords`` or ``requested_keywords``; a keyword listed twice is named once.
    """
    found = _with_values(wanted, values).filter(F.col("value").isNotNull())
    lost = found.select("exposure_id", "keyword", card_reason(F.col("keyword"), F.col("value")).alias("reason"))
    return lost.filter(F.col("reason").isNotNull()).distinct()


def _assemble(wanted: DataFrame, values: DataFrame) -> DataFrame:
    """One header per exposure of ``wanted (exposure_id, pos, keyword)``; keywords without a value are skipped.

    A header has at most as many cards as its list has keywords, which bounds the array.
    """
    found = _with_values(wanted, values)
    cards = found.withColumn("card", fits_card(F.col("keyword"), F.col("value")))
    ordered = F.sort_array(F.collect_list(F.when(F.col("card").isNotNull(), F.struct("pos", "card"))))
    return (
        cards.groupBy("exposure_id")
        .agg(ordered.alias("cards"))
        .select("exposure_id", F.array_join(F.col("cards.card"), "\n").alias("header"))
    )


def exposure_keywords(exposures: DataFrame, header_lists: DataFrame) -> DataFrame:
    """``(exposure_id, pos, keyword)`` from the list of each exposure's subsystem.

    An exposure whose subsystem has no list keeps one row without a keyword.
    """
    lists = header_lists.select(F.upper("subsystem").alias("subsystem"), "pos", "keyword")
    asked = exposures.select("exposure_id").filter(F.col("exposure_id").isNotNull()).distinct()
    return (
        asked.withColumn("subsystem", exposure_subsystem(F.col("exposure_id")))
        .join(broadcast_if_small(lists), "subsystem", "left")
        .select("exposure_id", "pos", "keyword")
    )


def fits_headers(exposures: DataFrame, header_lists: DataFrame, values: DataFrame) -> DataFrame:
    """``(exposure_id, header)`` for every requested exposure, cards in list order.

    ``values`` hold one row per exposure and keyword. An exposure without values has an empty header.
    """
    return _assemble(exposure_keywords(exposures, header_lists), narrow_to(values, "exposure_id", exposures))


def requested_keywords(requests: DataFrame) -> DataFrame:
    """``(exposure_id, pos, keyword)`` of requests ``(exposure_id, keywords)`` whose keywords are comma-separated.

    A keyword named twice keeps its first position.
    """
    named = requests.select("exposure_id", F.posexplode(F.split("keywords", ",")).alias("pos", "keyword"))
    return named.groupBy("exposure_id", "keyword").agg(F.min("pos").alias("pos"))


def header_subset(requests: DataFrame, values: DataFrame) -> DataFrame:
    """Headers with the requested keywords only, in request order; the exposure id may have any form."""
    return _assemble(requested_keywords(requests), narrow_to(values, "exposure_id", requests))


def ordered_header_list(header_lists: DataFrame, by: str = "subsystem") -> DataFrame:
    """Keywords of each list joined in list order."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "keyword")))
    return header_lists.groupBy(by).agg(ordered.alias("k")).select(by, F.array_join("k.keyword", ",").alias("keywords"))

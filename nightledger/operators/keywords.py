"""Keyword values of exposures, and the reasons for those that could not be derived."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightledger.functions.keys import exposure_subsystem, normal_key
from nightledger.functions.params import EVENT_MISSING, all_params, lookup
from nightledger.operators.sizes import SMALL_VALUES, broadcast_if_small, few_values
from nightledger.operators.snapshot import OBSERVE_COLUMNS, event_snapshot
from nightledger.sources.config import CONSTANT
from nightledger.sources.tables import staged

#: What a mapping reads from its channel.
ASKED = ["key_name", "key_index", "attribute"]


def params_long(events: DataFrame) -> DataFrame:
    """One row per parameter of every event: type, name, units and values as text."""
    kinds = events.schema["paramSet"].dataType
    rest = [c for c in events.columns if c != "paramSet"]
    return events.select(*rest, F.explode(all_params(F.col("paramSet"), kinds)).alias("p")).select(*rest, "p.*")


def mapped_keys(mappings: DataFrame) -> DataFrame:
    """The channels that classified mappings read."""
    return (
        mappings.filter(F.col("event_key").isNotNull())
        .select(normal_key(F.col("event_key")).alias("event_key"))
        .distinct()
    )


def asked_params(events: DataFrame, mappings: DataFrame) -> DataFrame:
    """The events of mapped channels, each with only the parameters that some mapping reads from its channel.

    Taken before a snapshot, it keeps what no keyword needs out of every shuffle. An event without parameters keeps its
    null ``paramSet``; parameters that are not asked for are left out of their lists.
    """
    read = mappings.filter(F.col("event_key").isNotNull())
    asked = read.groupBy(normal_key(F.col("event_key")).alias("event_key")).agg(F.collect_set("key_name").alias("names"))
    kinds = events.schema["paramSet"].dataType.fieldNames()

    def named(kind: str) -> Column:
        return F.filter(F.col("paramSet")[kind], lambda p: F.array_contains("names", p["keyName"])).alias(kind)

    kept = F.when(F.col("paramSet").isNotNull(), F.struct(*map(named, kinds)))
    rows = events.join(broadcast_if_small(asked), "event_key").withColumn("paramSet", kept)
    return rows.select(*events.columns)


def keyword_outcomes(observes: DataFrame, snapshot: DataFrame, mappings: DataFrame) -> DataFrame:
    """One row per observe event and applicable mapping, with a value or the reason there is none.

    ``mappings`` are merged and classified. An observe event's subsystem comes from its exposure id.
    """
    asked = observes.withColumn("subsystem", exposure_subsystem(F.col("exposure_id")))
    rules = mappings.withColumn("subsystem", F.upper("subsystem")).withColumn(
        "event_key", normal_key(F.col("event_key"))
    )
    rules = rules.select(
        "subsystem", "obs_event_name", "keyword", "kind", "value", "event_key", "key_name", "key_index", "attribute"
    )
    wanted = asked.join(broadcast_if_small(rules), ["subsystem", "obs_event_name"])
    kinds = snapshot.schema["paramSet"].dataType
    keys = few_values(rules, "event_key")
    if keys is not None and len(keys) <= SMALL_VALUES:
        snapshot = snapshot.filter(F.col("event_key").isin(*keys))  # states that no rule reads need not be shuffled
    states = snapshot.select("obs_event_id", "obs_time", "event_key", "paramSet", F.lit(True).alias("seen"))
    derived = lookup(F.col("paramSet"), kinds, F.col("key_name"), F.col("key_index"), F.col("attribute"))
    missing = F.struct(F.lit(None).cast("string").alias("value"), F.lit(EVENT_MISSING).alias("reason"))
    out = OBSERVE_COLUMNS + ["subsystem", "keyword", "value", "reason"]
    complex_rows = (
        wanted.filter(F.col("kind") != CONSTANT)
        .drop("value")
        .join(states, ["obs_event_id", "obs_time", "event_key"], "left")
        .withColumn("o", F.when(F.col("seen").isNull(), missing).otherwise(derived))
        .select("*", "o.value", "o.reason")
    )
    constants = wanted.filter(F.col("kind") == CONSTANT).withColumn("reason", F.lit(None).cast("string"))
    return constants.select(*out).unionByName(complex_rows.select(*out))


def keyword_extract(observes: DataFrame, snapshot: DataFrame, mappings: DataFrame) -> DataFrame:
    """The keyword values each observe event gives its exposure."""
    found = keyword_outcomes(observes, snapshot, mappings).filter(F.col("reason").isNull())
    return found.select(*OBSERVE_COLUMNS, "keyword", "value")


def with_texts(events: DataFrame, asked: DataFrame) -> DataFrame:
    """Events with ``texts``, the value (or the reason there is none) of everything ``asked`` of their channel.

    ``asked`` has one row per channel, with ``asks``, an array of ``ASKED`` structs. The parameter set is read where it
    is scanned and goes no further.
    """
    kinds = events.schema["paramSet"].dataType

    def text(ask: Column) -> Column:
        return lookup(F.col("paramSet"), kinds, *[ask[c] for c in ASKED])

    return events.join(asked, "event_key").withColumn("texts", F.transform("asks", text)).drop("asks", "paramSet")


def keywords_from_bus(bus: DataFrame, observes: DataFrame, mappings: DataFrame) -> DataFrame:
    """What ``keyword_extract`` gives for the snapshots of the bus, without shuffling a parameter set.

    Of each event of a mapped channel only the few texts that mappings read from it take part in the snapshot; a rule
    then takes its text by position. The observe events are written to the shared folder with their subsystem, since
    they are read for the cells, their lists and the constants.
    """
    rules = mappings.withColumn("subsystem", F.upper("subsystem"))
    rules = rules.withColumn("event_key", normal_key(F.col("event_key")))
    keys = few_values(rules, "event_key")

    def config(table: DataFrame) -> DataFrame:
        return table if keys is None else F.broadcast(table)  # no table made of the mappings has more rows than they

    read = rules.filter((F.col("kind") != CONSTANT) & F.col("event_key").isNotNull())
    asks = read.groupBy("event_key").agg(F.sort_array(F.collect_set(F.struct(*ASKED))).alias("asks"))
    placed = read.join(config(asks), "event_key").select(
        "subsystem", "obs_event_name", "event_key", "keyword", F.array_position("asks", F.struct(*ASKED)).cast("int").alias("slot")
    )
    few = keys is not None and len(keys) <= SMALL_VALUES
    mapped = bus.filter(F.col("event_key").isin(*keys)) if few else bus
    events = with_texts(mapped, config(asks))
    asked = staged(observes.withColumn("subsystem", exposure_subsystem(F.col("exposure_id"))))
    reading = asked.join(config(placed), ["subsystem", "obs_event_name"], "left_semi")
    snapshot = event_snapshot(events, observes=reading, columns=["texts"])
    met = snapshot.join(config(placed), ["subsystem", "obs_event_name", "event_key"])
    found = met.withColumn("o", F.get("texts", F.col("slot") - 1)).filter(F.col("o.reason").isNull())
    constants = rules.filter(F.col("kind") == CONSTANT).select("subsystem", "obs_event_name", "keyword", "value")
    given = asked.join(config(constants), ["subsystem", "obs_event_name"])
    out = [*OBSERVE_COLUMNS, "keyword"]
    return given.select(*out, "value").unionByName(found.select(*out, F.col("o.value").alias("value")))


def keyword_rejects(observes: DataFrame, snapshot: DataFrame, mappings: DataFrame) -> DataFrame:
    """The keywords that got no value, with the reason."""
    lost = keyword_outcomes(observes, snapshot, mappings).filter(F.col("reason").isNotNull())
    return lost.select(*OBSERVE_COLUMNS, "keyword", "reason")


def constant_keywords(observes: DataFrame, mappings: DataFrame) -> DataFrame:
    """The constant keyword values of each observe event."""
    asked = observes.withColumn("subsystem", exposure_subsystem(F.col("exposure_id")))
    rules = mappings.filter(F.col("kind") == CONSTANT).select(
        F.upper("subsystem").alias("subsystem"), "obs_event_name", "keyword", "value"
    )
    found = asked.join(broadcast_if_small(rules), ["subsystem", "obs_event_name"])
    return found.select(*OBSERVE_COLUMNS, "keyword", "value")

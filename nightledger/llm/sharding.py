"""Sharding: rendezvous hashing of record keys over weighted shards, and gapless numbering inside each shard.

A record goes to the shard with the highest score ``-weight / ln(u)``, where u in (0, 1) is a hash of key and shard
number. The scores of the old shards do not change when a shard is added, so a record either stays or moves to the new
one. Only DataFrame functions are used.

Nulls: all records with a null key share one shard. Text that is null counts no bytes. Repeated rows get slots of their
own; ties of the score go to the shard with the smaller number. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nightledger.llm.registry import query
from nightledger.llm.tables import documents, written

#: Records of one shard are numbered in so many ranges of their hash, so that a shard is never one task's work.
RANGES = 4096

#: Copies of one row that a single step spreads into rows.
COPIES = 100_000


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard, 0 to len(weights) - 1, of a key."""

    def score(shard: int, weight: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-F.lit(float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("shard"))

    if len(weights) == 1:
        return F.lit(0)
    return (-F.greatest(*[score(i, w) for i, w in enumerate(weights)])["shard"]).cast("int")


def numbered(rows: DataFrame, shard: str, order: str, slot: str = "slot") -> DataFrame:
    """The rows with a gapless number from 0 inside each shard, in the order of a hash of ``order``, then ``order``.

    The hash cuts a shard into RANGES ranges; sizes of the ranges before are added to the number inside one. Rows that
    are equal in every column are counted first and numbered together.
    """
    group = [F.col(c) for c in rows.columns]
    spread = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")).withColumn(
        "__range", F.pmod(F.xxhash64(F.col(order)), F.lit(RANGES)).cast("int")
    )
    sizes = spread.groupBy(shard, "__range").agg(F.sum("__n").alias("__size"))
    before = Window.partitionBy(shard).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(shard).alias("__shard"), F.col("__range").alias("__at"), F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__base")
    )
    inside = Window.partitionBy(shard, "__range").orderBy(order, *[c for c in rows.columns if c not in (shard, order)])
    start = F.coalesce(F.sum("__n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = spread.withColumn("__start", start).join(
        offsets, (F.col(shard).eqNullSafe(F.col("__shard"))) & (F.col("__range") == F.col("__at"))
    )
    blocks = placed.select(
        *rows.columns, "__n", (F.col("__base") + F.col("__start")).alias("__first"),
        F.explode(F.sequence(F.lit(0), F.col("__n") - 1, F.lit(COPIES))).alias("__block"),
    )
    last = F.least(F.col("__n"), F.col("__block") + COPIES) - 1
    return blocks.select(
        *rows.columns, "__first", F.explode(F.sequence(F.col("__block"), last)).alias("__copy")
    ).select(*rows.columns, (F.col("__first") + F.col("__copy")).alias(slot))


def sharded(docs: DataFrame, key: str, text: str, weights: Sequence[float], grown: Sequence[float]) -> DataFrame:
    """Key, size (UTF-8 bytes and 1), CRC-32 of the text, shard, slot, and the shard once there are more of them."""
    body = F.coalesce(F.col(text), F.lit(""))
    placed = docs.select(
        F.col(key).alias(key),
        (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), grown).alias("grown_shard"),
    )
    return numbered(written(placed, "shards"), "shard", key)


#: Primes of the published 64-bit xxHash (fixed values), for the SQL twin only.
PRIMES = [11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261]
MASK = (1 << 64) - 1


def _times(x: str, prime: int) -> str:
    return f"(({x}) * {PRIMES[prime - 1]}::UHUGEINT & {MASK}::UHUGEINT)"


def _rotated(x: str, bits: int) -> str:
    return f"((({x}) << {bits} & {MASK}::UHUGEINT) | (({x}) >> {64 - bits}))"


def _finish(source: str) -> str:
    """Column h of ``source`` after the last mixing step."""
    steps = [(33, 2), (29, 3)]
    for shift, prime in steps:
        source = f"SELECT * REPLACE ({_times(f'xor(h, h >> {shift})', prime)} AS h) FROM ({source})"
    return f"SELECT * REPLACE (xor(h, h >> 32) AS h) FROM ({source})"


def sharding_sql(shards: int) -> str:
    """The query in SQL for shards of equal weight: hash, highest score, slots in order of the hash range and the key."""
    key = f"(doc_id::HUGEINT & {MASK}::HUGEINT)::UHUGEINT"
    long_start, int_start = PRIMES[4] + 8 + 42, PRIMES[4] + 4
    mixed = f"xor({long_start}::UHUGEINT, {_times(_rotated(_times(key, 2), 31), 1)})"
    start = f"{_times(_rotated(mixed, 27), 1)} + {PRIMES[3]}::UHUGEINT & {MASK}::UHUGEINT"
    seeded = f"xor(key_hash + {int_start}::UHUGEINT & {MASK}::UHUGEINT, {_times('shard::UHUGEINT', 1)})"
    again = f"{_times(_rotated(seeded, 23), 2)} + {PRIMES[2]}::UHUGEINT & {MASK}::UHUGEINT"
    return f"""
    WITH RECURSIVE k AS (
      SELECT doc_id, coalesce(text, '') AS body, CASE WHEN doc_id IS NULL THEN 42::UHUGEINT ELSE h END AS key_hash
      FROM ({_finish(f"SELECT doc_id, text, {start} AS h FROM documents")})
    ), scores AS (
      SELECT doc_id, key_hash, shard, -1.0 / ln(((h >> 11)::DOUBLE + 0.5) / {1 << 53}) AS score
      FROM ({_finish(f"SELECT k.*, shard, {again} AS h FROM k, range({shards + 1}) r(shard)")})
    ), best AS (
      SELECT doc_id, key_hash,
             first(shard ORDER BY score DESC, shard) FILTER (shard < {shards})::INTEGER AS shard,
             first(shard ORDER BY score DESC, shard)::INTEGER AS grown_shard
      FROM scores GROUP BY doc_id, key_hash
    ), bits AS (
      SELECT b AS byte, b AS c, 0 AS i FROM range(256) t(b)
      UNION ALL
      SELECT byte, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i + 1 FROM bits WHERE i < 8
    ), crc AS (SELECT list(c ORDER BY byte) AS crc_of FROM bits WHERE i = 8)
    SELECT k.doc_id, (octet_length(encode(body)) + 1)::BIGINT AS size,
           xor(list_reduce(
             list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda h: ('0x' || h)::BIGINT),
             lambda c, b: xor(c >> 8, crc_of[xor(c & 255, b) + 1]), 4294967295), 4294967295) AS text_crc32,
           'key' AS law, shard,
           row_number() OVER (PARTITION BY shard ORDER BY k.key_hash & {RANGES - 1}::UHUGEINT, k.doc_id) - 1 AS slot, grown_shard
    FROM k JOIN best ON k.doc_id IS NOT DISTINCT FROM best.doc_id CROSS JOIN crc
    """


@query("op5_sharding", sharding_sql(16))
def op5(spark: SparkSession, sf_dir: str, shards: int = 16) -> DataFrame:
    rows = sharded(documents(spark, sf_dir), "doc_id", "text", [1.0] * shards, [1.0] * (shards + 1))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

"""Mixing sources to target weights by a min-cost flow, and a seeded choice of documents.

Documents may belong to several sources. They are aggregated by membership pattern, and only the patterns' word counts
enter the flow: start -> pattern (the first use of its words is free, each further use costs one more) -> any source of
the pattern -> end (the source's quota). As costs lie on the start arcs alone and are convex, the flow is found by filling
the network to the maximum with first uses, then with second uses on top, and so on. Patterns that share no source,
directly or over others, are solved apart from each other.

Targets: the mix has ``share`` times all words; sources in code point order (null last) weigh 3, 1, 2, 3, 1, 2, ...; no
target exceeds ``uses`` times its source, and what is above is shared anew by weight among the rest.

Choice: a pattern gives its words as whole copies of everything and a rest. Documents get one copy more in the order of
a seeded hash until the rest is used up; one document more, the closest in size to what is then missing, closes the gap.
Hash ranges are summed first, and only the range in which the rest ends is sorted, so a hot source is never one task.

Nulls: a null text has no words, a null source is a source. Rows that are equal in every column are told apart by
their number in the written table; which of them is taken makes no difference to the result. Empty tables give empty
results. Documents without words take no words.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nightledger.llm.registry import query
from nightledger.llm.tables import documents, unused_prefix, written
from nightledger.llm.words import Words, flat, slices

SEED = "mix-1"
WEIGHTS = (3, 1, 2)
SHARE, USES = 1.5, 2
RANGE_DIGITS = 3


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            words = Words(*flat(batch.column("text")))
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(np.diff(words.first))], names=[*kept, "size"])


def label(source: Column) -> Column:
    """A text for a source that sorts by code point, null last."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(">"))


def targets(sources: DataFrame, words: Column, share: float = SHARE, uses: int = USES) -> DataFrame:
    """label, source_size, target for (label, source_size); ``words`` is the count of all words, one row per source."""
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(Window.orderBy("label")) - 1) % len(WEIGHTS) + 1)
    rows = sources.withColumn("words", words).withColumn("weight", weight).withColumn("cap", F.col("source_size") * uses)
    # In order of cap per weight, the capped sources come first; each sees the level that is left by those before it.
    order = Window.orderBy(F.col("cap") / F.col("weight"), "label")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum("cap").over(before), F.lit(0))
    weights = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    rows = rows.withColumn("level", (F.col("words") * F.lit(share) - used) / weights).withColumn("place", F.row_number().over(order))
    # The first source that its level does not fill sets the level of all that follow.
    over = F.col("cap") > F.col("weight") * F.col("level")
    level = F.min_by("level", F.when(over, F.col("place"))).over(everything)
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * level, F.col("cap").cast("double")))
    return rows.select("label", "source_size", target.alias("target"))


def flow(sizes: list[int], members: list[list[int]], quotas: list[int], uses: int = USES) -> list[int]:
    """Words taken from each pattern: maximal, and of all maximal ones with the least repetition."""
    n, m = len(sizes), len(quotas)
    sent = [dict.fromkeys(own, 0) for own in members]
    taken, left = [0] * n, list(quotas)
    givers: list[set[int]] = [set() for _ in range(m)]
    for use in range(1, uses + 1):
        spare = [size * use - t for size, t in zip(sizes, taken, strict=True)]
        while True:
            # The shortest way from a pattern with words to a source with room; a source passes on what others gave it.
            came: dict[tuple[str, int], tuple[str, int] | None] = {("p", p): None for p in range(n) if spare[p] > 0}
            queue, found = deque(came), None
            while queue and found is None:
                kind, x = queue.popleft()
                if kind == "p":
                    steps = [("s", s) for s in members[x]]
                else:
                    if left[x] > 0:
                        found = ("s", x)
                        break
                    steps = [("p", p) for p in givers[x] if sent[p][x] > 0]
                for y in steps:
                    if y not in came:
                        came[y] = (kind, x)
                        queue.append(y)
            if found is None:
                break
            way, node = [], found
            while node is not None:
                way.append(node)
                node = came[node]
            way.reverse()
            amount = min(spare[way[0][1]], left[found[1]])
            for a, b in zip(way, way[1:], strict=False):
                if a[0] == "s":
                    amount = min(amount, sent[b[1]][a[1]])
            for a, b in zip(way, way[1:], strict=False):
                if a[0] == "p":
                    sent[a[1]][b[1]] += amount
                    givers[b[1]].add(a[1])
                else:
                    sent[b[1]][a[1]] -= amount
            taken[way[0][1]] += amount
            spare[way[0][1]] -= amount
            left[found[1]] -= amount
    return taken


def routed(uses: int):
    """The flow of one component: its (members, pattern_size, quotas) rows with the words taken from each."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        quota = {x: int(q) for own, qs in zip(rows["members"], rows["quotas"], strict=True) for x, q in zip(own, qs, strict=True)}
        number = {x: i for i, x in enumerate(sorted(quota))}
        members = [[number[x] for x in own] for own in rows["members"]]
        taken = flow([int(x) for x in rows["pattern_size"]], members, [quota[x] for x in number], uses)
        return pd.DataFrame({"members": rows["members"], "pattern_size": rows["pattern_size"], "taken": taken})

    return solve


def components(patterns: DataFrame) -> DataFrame:
    """The patterns with the smallest source label that each reaches over shared sources."""
    edges = written(patterns.select("members", F.explode("members").alias("label"), F.col("members")[0].alias("part")), "patterns")
    while True:
        low = edges.groupBy("label").agg(F.min("part").alias("low"))
        at = edges.join(low, "label").groupBy("members").agg(F.min("low").alias("low"), F.min("part").alias("part"))
        moved = written(at.select("members", F.explode("members").alias("label"), F.col("low").alias("part"), (F.col("low") < F.col("part")).alias("moved")), "patterns")
        edges = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return patterns.join(edges.select("members", "part").distinct(), "members")


def mixed(docs: DataFrame, members: Column, id_column: str = "doc_id", text: str = "text", share: float = SHARE,
          uses: int = USES, seed: str = SEED) -> DataFrame:
    """id, members, size, copies, taken, and the sizes and targets of the row's sources, for every row.

    ``members`` is the array of the labels of a row's sources.
    """
    named = docs.select(
        F.col(id_column).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"),
        F.array_sort(F.array_distinct(members)).alias("members"), F.col(text).cast("string").alias("text"),
    )
    table = written(named.mapInArrow(counted, "id long, row long, members array<string>, size long"), "sizes")

    patterns = table.groupBy("members").agg(F.sum("size").alias("pattern_size"))
    words = F.sum("own").over(Window.partitionBy())
    # A pattern's words count once in the whole, and once for each of its sources.
    sources = patterns.select(
        F.posexplode("members").alias("k", "label"), "pattern_size"
    ).groupBy("label").agg(F.sum("pattern_size").alias("source_size"), F.sum(F.when(F.col("k") == 0, F.col("pattern_size")).otherwise(0)).alias("own"))
    goals = written(targets(sources, words, share, uses), "targets")
    named_goals = (
        patterns.select("members", "pattern_size", F.posexplode("members").alias("k", "label"))
        .join(goals, "label")
        .groupBy("members", "pattern_size")
        .agg(F.array_sort(F.collect_list(F.struct("k", "source_size", "target"))).alias("goals"))
        .select(
            "members", "pattern_size", F.col("goals.source_size").alias("source_sizes"), F.col("goals.target").alias("targets"),
            F.transform("goals", lambda g: F.round(g["target"]).cast("long")).alias("quotas"),
        )
    )
    network = written(named_goals, "patterns")
    if network.filter(F.size("members") > 1).isEmpty():
        parts = network.withColumn("part", F.col("members")[0])
    else:
        parts = components(network)
    solved = parts.select("part", "members", "pattern_size", "quotas").groupBy("part").applyInPandas(
        routed(uses), "members array<string>, pattern_size long, taken long"
    )
    whole = F.when(F.col("pattern_size") > 0, F.floor(F.col("taken") / F.col("pattern_size"))).otherwise(0).cast("long")
    plan = network.select("members", "source_sizes", "targets").join(
        solved.withColumn("whole", whole).select("members", "whole", (F.col("taken") - F.col("whole") * F.col("pattern_size")).alias("rest")), "members"
    )
    plan = written(plan, "plan")

    # The seeded order, cut into ranges by the first digits of the hash.
    seeded = table.withColumn("hash", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("id").cast("string"), F.lit("null"))).cast("binary")))
    seeded = seeded.withColumn("range", F.substring("hash", 1, RANGE_DIGITS))
    ranges = seeded.groupBy("members", "range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("members").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = written(
        ranges.withColumn("base", F.coalesce(F.sum("range_size").over(before), F.lit(0))).join(plan, "members"), "ranges"
    )
    placed = seeded.join(ranges, ["members", "range"])
    full, none = F.col("base") + F.col("range_size") <= F.col("rest"), F.col("base") >= F.col("rest")
    sure = placed.filter(full | none).withColumn("extra", F.when(full, 1).otherwise(0))
    inside = Window.partitionBy("members", "range").orderBy("hash", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    split = placed.filter(~full & ~none).withColumn("extra", F.when(F.col("base") + F.sum("size").over(inside) <= F.col("rest"), 1).otherwise(0))
    chosen = written(sure.unionByName(split).drop("base", "range_size"), "chosen")

    # The document that comes closest to closing the gap. Rows meet their pattern's gap by range and the answer by their
    # own number, so that a hot pattern's rows are never dealt by the pattern alone.
    got = chosen.groupBy("members").agg((F.first("rest") - F.sum(F.col("extra") * F.col("size"))).alias("gap"))
    gaps = ranges.select("members", "range").join(got, "members")
    off = F.abs(F.col("gap") - F.col("size"))
    last = (
        chosen.filter("extra = 0").join(gaps, ["members", "range"]).filter(off < F.col("gap"))
        .groupBy("members").agg(F.min(F.struct(off.alias("off"), "hash", "size", "row")).alias("last"))
        .select(F.col("last.row").alias("row"), F.lit(1).alias("last"))
    )
    copies = F.col("whole") + F.col("extra") + F.coalesce("last", F.lit(0))
    return chosen.join(last, "row", "left").select(
        "id", "row", "members", "size", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "source_sizes", "targets"
    )


def repeated(docs: DataFrame, source: str = "source", id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of the mix: a row as often as it is taken."""
    taken = mixed(docs, F.array(label(F.col(source))), id_column, text).filter("copies > 0")
    # Rows that share id and source share one order of the hash; they are told apart by their size.
    own = unused_prefix(docs)
    # The ranks and the join deal rows by the same three columns, none of them null, so that texts are shuffled once.
    key = [f"{own}id", f"{own}source", f"{own}size"]

    def named(value: Column) -> Column:
        return F.coalesce(value.cast("long").cast("string"), F.lit("null"))

    plan = taken.groupBy(
        named(F.col("id")).alias(key[0]), F.col("members")[0].alias(key[1]), F.col("size").cast("int").alias(key[2])
    ).agg(F.sort_array(F.collect_list("copies"), asc=False).alias(f"{own}copies"))
    size = F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    sized = docs.withColumns({key[0]: named(F.col(id_column)), key[1]: label(F.col(source)), key[2]: size})
    sized = sized.withColumn(f"{own}rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64(text))))
    copies = F.coalesce(F.get(f"{own}copies", F.col(f"{own}rank") - 1), F.lit(0)).cast("int")
    rows = sized.join(plan, key).withColumn(f"{own}n", copies)
    return rows.withColumn(f"{own}k", F.explode(F.array_repeat(F.lit(0), F.col(f"{own}n")))).select(*docs.columns)


@query(
    "op2_mixing",
    f"""
    WITH d AS (
      SELECT doc_id, coalesce('=' || source, '>') AS label, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
             md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS hash
      FROM documents
    ),
    s AS (
      SELECT label, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY label) - 1) % 3)::INT + 1] AS weight
      FROM d GROUP BY label
    ),
    o AS (
      SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2 * source_size) OVER b, 0))
                / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level,
             row_number() OVER (ORDER BY 2 * source_size / weight, label) AS place
      FROM s
      WINDOW b AS (ORDER BY 2 * source_size / weight, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ),
    t AS (
      SELECT label, source_size,
             least((2 * source_size)::DOUBLE, coalesce(weight * arg_min(level, place) FILTER (2 * source_size > weight * level)
                   OVER (), 2 * source_size)) AS target
      FROM o
    ),
    q AS (SELECT *, least(round(target)::BIGINT, 2 * source_size) AS quota FROM t),
    p AS (SELECT *, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS whole FROM q),
    r AS (SELECT *, quota - whole * source_size AS rest FROM p),
    c AS (SELECT d.*, r.* EXCLUDE (label), sum(size) OVER (PARTITION BY d.label ORDER BY hash, size, doc_id ROWS UNBOUNDED PRECEDING) AS run
          FROM d JOIN r ON d.label = r.label),
    e AS (SELECT *, CASE WHEN run <= rest AND rest > 0 THEN 1 ELSE 0 END AS extra FROM c),
    g AS (SELECT *, rest - sum(extra * size) OVER (PARTITION BY label) AS gap FROM e),
    f AS (SELECT label, min(struct_pack(a := abs(gap - size), b := hash, c := size)) AS last FROM g
          WHERE extra = 0 AND abs(gap - size) < gap GROUP BY label)
    SELECT doc_id, size::BIGINT AS size, source_size, target,
           (size * (whole + extra + CASE WHEN extra = 0 AND last.b = hash AND last.c = size THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM g LEFT JOIN f USING (label)
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed(documents(spark, sf_dir), F.array(label(F.col("source"))))
    return rows.select(
        F.col("id").alias("doc_id"), "size", F.col("source_sizes")[0].alias("source_size"), F.col("targets")[0].alias("target"), "taken"
    )

"""Filter interaction audit: what a set of filters removes, alone, in every order and together.

The removal game of a part (a source) gives every coalition of filters the number of documents that fail at least one of
them. Its Hart-Mas-Colell potential is found recursively from the smaller coalitions to the larger ones: the potential of
a coalition S is (removed(S) + sum of the potentials of S without one member) / size of S, and that of none is 0. A
filter's Shapley value is the potential of all filters minus that of all but it. Differences of coalitions give every
step of every order: what a filter removes after others is removed(others and it) - removed(others). No order is ever
applied to documents; with five filters 32 coalitions stand for 120 orders of five steps.

Counts are whole numbers: potentials are kept multiplied by (number of filters)!, with which all of them are whole.

How the work is spread: texts are read once and leave a narrow row (id, part, failed filters, SHA-256 of the text),
written to the shared folder. Equal texts have one first id, found by an aggregate with partial sums; a row is told
whether it is the first by a join on text digest *and* id, so a text that a third of all documents have is not one key.
The same rows meet the labels by id. Then everything is counted per part, set of failed filters and labels: a part has at
most (two to the number of filters) times four rows, however many documents it has, and the game of a part is one row.

Nulls: a null text is empty; a null part counts as the empty string; a null id is never a copy of another row, is copied
by none, and has no label. Rows that share an id and a text are not copies of each other; each counts. A document with
several label rows has a label if one of them says so; null labels say nothing. An empty text has no words, so it fails
the first filter only (and the copy filter, if another empty text has a smaller id). Very long texts are measured in one
piece of a task's memory. An empty table gives no parts and so no rows; extra columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from itertools import combinations, permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightledger.llm.registry import query
from nightledger.llm.tables import documents, written
from nightledger.llm.words import Words, flat, slices, sums

MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 50, 65, 5
FILTERS = "ABCDE"
SHORT, REPETITIVE, SHOUTING, SYMBOLS, COPY = (1 << i for i in range(5))

UPPER, SIGNS = np.zeros(256, bool), np.zeros(256, bool)
UPPER[ord("A") : ord("Z") + 1] = True
SIGNS[list(b"#$%&*|")] = True

MEASURES = ("docs", "good", "toxic")


def failed(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each text, the filters on the text alone that it fails, as a sum of their bits."""
    words = Words(data, at)
    ids, n = words.ids(), np.diff(words.first)
    pair = words.text * (int(ids.max(initial=0)) + 1) + ids
    distinct = np.bincount(np.unique(pair) // (int(ids.max(initial=0)) + 1), minlength=len(n))
    out = np.where(n < MIN_WORDS, SHORT, 0)
    out |= np.where(100 * distinct < DISTINCT_PERCENT * n, REPETITIVE, 0)
    points = sums((data & 0xC0) != 0x80, at)
    out |= np.where(100 * sums(UPPER[data], at) > UPPER_PERCENT * points, SHOUTING, 0)
    return out | np.where(sums(SIGNS[data], at) > 0, SYMBOLS, 0)


def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            mask = pa.array(failed(*flat(batch.column("text"))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("id", "part", "digest")] + [mask], names=["id", "part", "digest", "mask"]
            )


def text_flags(docs: DataFrame, id_column: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """id, part, digest of the text and ``mask`` (bits of the failed filters on the text alone), written."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(id_column).alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(whole, 256)).alias("digest"),
        whole.alias("text"),
    )
    kind = docs.schema[id_column].dataType.simpleString()
    return written(narrow.mapInArrow(judged, f"id {kind}, part string, digest binary, mask int"), "flags")


def with_copies(flags: DataFrame) -> DataFrame:
    """The flags with the bit of the copy filter for rows whose text stands at a smaller id, too."""
    first = flags.filter(F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("id"))
    named = flags.filter(F.col("id").isNotNull()).join(first.withColumn("own", F.lit(True)), ["digest", "id"], "left")
    marked = F.when(F.col("own"), F.col("mask")).otherwise(F.col("mask").bitwiseOR(COPY))
    return named.select("id", "part", marked.alias("mask"))


def with_labels(rows: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Rows with ``good`` and ``toxic`` as 1 or 0."""
    known = labels.filter(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(
        *[F.max((F.col(c) == 1).cast("int")).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    )
    joined = rows.join(known, "id", "left")
    return joined.select("part", "mask", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])


def counted(rows: DataFrame) -> DataFrame:
    """part, mask, docs, good, toxic: how many documents fail exactly the filters of ``mask``."""
    one = F.count(F.lit(1)).alias("docs")
    return rows.groupBy("part", "mask").agg(one, *[F.sum(F.col(c).cast("long")).alias(c) for c in ("good", "toxic")])


def coalition(members: Sequence[int]) -> int:
    return sum(1 << i for i in members)


def removal_game(counts: DataFrame, filters: int) -> DataFrame:
    """One row per part: all its documents, and arrays ``docs``, ``good`` and ``toxic`` of what each coalition removes.

    A part has at most one row for each of the coalitions, which are collected.
    """
    sets = counts.groupBy("part").agg(F.sum("docs").alias("total"), F.collect_list(F.struct("mask", *MEASURES)).alias("sets"))

    def removed(measure: str) -> Column:
        def by(s: Column) -> Column:
            hit = F.filter("sets", lambda x: x["mask"].bitwiseAND(s) != 0)
            return F.aggregate(hit, F.lit(0).cast("long"), lambda n, x: n + x[measure])

        return F.transform(F.sequence(F.lit(0), F.lit((1 << filters) - 1)), by).alias(measure)

    return sets.select("part", "total", *map(removed, MEASURES))


def with_potentials(game: DataFrame, filters: int) -> DataFrame:
    """The game with ``potential_S`` of every coalition S, times (number of filters)!."""
    game = game.withColumn("potential_0", F.lit(0).cast("long"))
    for size in range(1, filters + 1):
        level = {}
        for members in combinations(range(filters), size):
            s = coalition(members)
            smaller = [F.col(f"potential_{s - (1 << i)}") for i in members]
            whole = F.get("docs", F.lit(s)) * factorial(filters) + sum(smaller[1:], start=smaller[0])
            level[f"potential_{s}"] = F.call_function("div", whole, F.lit(size))
        game = game.withColumns(level)
    return game


def all_steps(filters: str) -> Column:
    """Every step of every order: the order, the step, its filter's coalition, and the coalitions before it and with it."""
    steps = []
    for order in permutations(range(len(filters))):
        for k, own in enumerate(order):
            before = coalition(order[:k])
            name = "".join(filters[i] for i in order)
            steps.append({"filter_order": name, "step": k + 1, "own": 1 << own, "before": before, "after": before | 1 << own})
    schema = "array<struct<filter_order:string,step:int,own:int,before:int,after:int>>"
    return F.from_json(F.lit(json.dumps(steps)), schema)


def audited(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from counts per part and mask (bit i: fails filter i).

    kept, removed: documents left after the step, and removed by it. redundant: fail the step's filter and were removed
    before. unique_fails: fail no other filter. good_lost, toxic_lost: removed here with that label. shapley: the filter's
    removals summed over all orders, which is its Shapley value times (number of filters)!.
    """
    every = (1 << len(filters)) - 1
    game = with_potentials(removal_game(counts, len(filters)), len(filters))
    potentials = F.array(*[F.col(f"potential_{s}") for s in range(every + 1)])
    rows = game.select("part", "total", *MEASURES, potentials.alias("potential"))
    rows = rows.withColumn("at", F.explode(all_steps(filters)))
    own, before, after, others = F.col("at.own"), F.col("at.before"), F.col("at.after"), every - F.col("at.own")

    def here(measure: str) -> Column:
        return F.get(measure, after) - F.get(measure, before)

    return rows.select(
        "part",
        "at.filter_order",
        "at.step",
        (F.col("total") - F.get("docs", after)).alias("kept"),
        here("docs").alias("removed"),
        (F.get("docs", own) - here("docs")).alias("redundant"),
        (F.get("docs", F.lit(every)) - F.get("docs", others)).alias("unique_fails"),
        here("good").alias("good_lost"),
        here("toxic").alias("toxic_lost"),
        (F.get("potential", F.lit(every)) - F.get("potential", others)).alias("shapley"),
    )


def filter_audit(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """The audit of the five filters A to E over documents and their labels (quality, toxic), per part."""
    flags = text_flags(docs, id_column, text, part)
    named = counted(with_labels(with_copies(flags), labels, id_column))
    nameless = flags.filter(F.col("id").isNull()).select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    return audited(named.unionByName(counted(nameless)))


@query(
    "op11_filter_audit",
    """
    WITH t AS (
      SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
             regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
      FROM documents
    ), f AS (
      SELECT t.doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
             100 * length(regexp_replace(t.t, '[^A-Z]', '', 'g')) > 5 * length(t.t) AS c, regexp_matches(t.t, '[#$%&*|]') AS d,
             coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY t.t), false) AS e,
             coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
      FROM t LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1) l
        ON l.doc_id = t.doc_id
    ), m AS (
      SELECT part, good, toxic, MAP {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS fails, count(*) AS n
      FROM f GROUP BY ALL
    ), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), orders AS (
      SELECT p.x || q.x || r.x || s.x || u.x AS o FROM letters p, letters q, letters r, letters s, letters u
      WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5
    ), steps AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM orders), seen AS (
      SELECT part, o, step, o[step] AS x, n, good, toxic, fails[o[step]] AS own,
             len(list_filter(string_split(o[1:step - 1], ''), lambda y: coalesce(fails[y], false))) > 0 AS gone,
             len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda y: y <> o[step] AND fails[y])) > 0 AS other
      FROM m, steps
    ), r AS (
      SELECT part, o, step, x, sum(n) FILTER (NOT own AND NOT gone) AS kept, sum(n) FILTER (own AND NOT gone) AS removed,
             sum(n) FILTER (own AND gone) AS redundant, sum(n) FILTER (own AND NOT other) AS unique_fails,
             sum(n) FILTER (own AND NOT gone AND good) AS good_lost, sum(n) FILTER (own AND NOT gone AND toxic) AS toxic_lost
      FROM seen GROUP BY ALL
    )
    SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept,
           CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
           CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
           CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
           CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
    FROM r
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))

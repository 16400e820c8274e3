"""Exact dedup: distributed radix partitioning from the first byte on.

Documents are split by their bytes [0, 16), [16, 80), [80, 336), ... (widths grow fourfold), level by level. A group
at a level is the documents that agree in all bytes so far. A group of one needs no further bytes, and neither does a
group whose texts have ended; the rest goes on with what is left of its text. No digest decides: two documents are
equal when all their bytes have been seen to be equal.

Groups are counted by a partial aggregate before anything is shuffled, so a group of copies of any size is one row per
task, and the members learn their group by a join that Spark splits when a group is hot. Each level is written to the
shared folder; the next reads it there, and then it goes: the answers of the groups that have ended are kept apart.

Nulls: a null text counts as empty. Of equal texts the row with the largest doc_id stays; a null doc_id is smaller than
any other. Rows with equal text and equal doc_id are copies of each other: one row is returned for each, all of them
with the same answer. Empty tables give empty results; other columns are not touched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from nightledger.llm.registry import query
from nightledger.llm.tables import ascii_lower, documents, dropped, written

FIRST_WIDTH = 16
GROWTH = 4

KEY = ("group", "piece", "ended")


def split(rows: DataFrame, width: int) -> DataFrame:
    """One level: the rows with the size and the largest id of their group of equal ``group``, next bytes and end.

    ``group`` names the group the level before made. The new name is the largest row name in the group, which no other
    group of the level has.
    """
    cut = rows.select(
        "*",
        F.substring("rest", 1, width).alias("piece"),
        (F.octet_length("rest") <= width).alias("ended"),
    )
    groups = cut.groupBy(*[F.col(c).alias(f"g_{c}") for c in KEY]).agg(
        F.count(F.lit(1)).alias("size"), F.max("id").alias("top"), F.max("row").alias("name")
    )
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"g_{c}")) for c in KEY])
    rest = F.when(~F.col("ended") & (F.col("size") > 1), F.expr(f"substring(rest, {width + 1})"))
    return cut.join(groups, same).select("id", "row", "sha", F.col("name").alias("group"), "size", "top", rest.alias("rest"))


def exact_groups(docs: DataFrame, id_column: str, text: Column, number: Column | None = None) -> DataFrame:
    """id, keep (largest id of the equal texts), size of the group, and SHA-256 of the text, for every row.

    With ``number``, which numbers the rows: ``row`` (id and number) and ``last``, the largest ``row`` of the equal
    texts, take the place of the digest.
    """
    rest = F.coalesce(text, F.lit("")).cast("binary").alias("rest")
    rows = docs.select(F.col(id_column).alias("id"), rest, *([] if number is None else [number.alias("number")]))
    # Rows that share an id but not a text must not lend their name to two groups.
    rows = rows.select(
        "id",
        F.struct(F.col("id"), (F.xxhash64("rest") if number is None else F.col("number")).alias("mark")).alias("row"),
        (F.sha2("rest", 256) if number is None else F.lit(None).cast("string")).alias("sha"),
        F.lit(None).cast(StructType([StructField("id", docs.select(id_column).schema[0].dataType), StructField("mark", LongType())])).alias("group"),
        "rest",
    )
    done, width, before = [], FIRST_WIDTH, None
    while True:
        level = written(split(rows, width), "radix")
        if before is not None:
            dropped(before)
        before = level
        ended = level.filter(F.col("rest").isNull())
        given = ["sha"] if number is None else ["row", F.col("group").alias("last")]
        done.append(written(ended.select("id", F.col("top").alias("keep"), "size", *given), "ended"))
        rows = level.filter(F.col("rest").isNotNull()).select("id", "row", "sha", "group", "rest")
        if rows.isEmpty():
            dropped(level)
            return reduce(DataFrame.unionAll, done)
        width *= GROWTH


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without the copies; of rows that share text and id, one stays.

    Rows are numbered and stored first, and the number says which stay: neither here does a digest decide.
    """
    packed = docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("number"))
    packed = written(packed, "numbered")
    groups = exact_groups(packed, f"doc.`{id_column}`", ascii_lower(F.col(f"doc.`{text}`")), F.col("number"))
    stays = groups.filter(F.col("row.mark") == F.col("last.mark")).select(F.col("row.mark").alias("number"))
    return packed.join(stays, "number", "left_semi").select("doc.*")


@query(
    "op6_exact_dedup",
    """
    WITH n AS (
      SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
      FROM documents
    )
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM n WINDOW w AS (PARTITION BY t)
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(documents(spark, sf_dir), "doc_id", ascii_lower(F.col("text")))
    return groups.select(
        F.col("id").alias("doc_id"),
        F.col("keep").alias("keep_id"),
        F.col("size").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )

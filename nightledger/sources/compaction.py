"""Compacting an archive while conversions append to it: generations of days, and a pointer that readers follow.

Below a root lie ``generation=0``, to which conversions append, later generations with the days that were rewritten,
``absorbed`` with the files that each rewrite read, and ``live`` with the pointers. The newest pointer says which
generation holds a day. Files of ``generation=0`` that no rewrite has read stay part of their day, so events that arrive
for a compacted day are read at once and absorbed by the next run. A pointer is renamed into place after everything
else; a run that dies before leaves files that nobody reads.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightledger.operators.sizes import SMALL_VALUES, broadcast_if_small
from nightledger.schema import CHANNEL_COLUMNS, archive_schema, event_schema
from nightledger.session import scratch
from nightledger.sources import files
from nightledger.sources.archive import write_archive

TARGET_BYTES = 128 << 20
DAY_COLUMNS = CHANNEL_COLUMNS[:3]
Day = tuple[int, int, int]


def incoming(root: str) -> str:
    """Where conversions append."""
    return f"{root.rstrip('/')}/generation=0"


def _day_folder(generation: int, day: Day) -> str:
    year, month, number = day
    return f"generation={generation}/year={year}/month={month}/day={number}"


def _pointer(spark: SparkSession, root: str) -> tuple[str | None, list[int], dict[Day, int]]:
    """Name of the newest pointer, the generations it counts as done, and the generation of each compacted day."""
    last = files.newest(spark, f"{root}/live")
    if last is None:
        return None, [], {}
    found = files.read_json(spark, f"{root}/live/{last}")
    return last, found["generations"], {(y, m, d): generation for y, m, d, generation in found["days"]}


def _absorbed(spark: SparkSession, root: str, generations: list[int]) -> DataFrame | None:
    """Files that the rewrites have read, by their path below the root."""
    paths = [f"{root}/absorbed/generation={g}" for g in generations]
    return spark.read.schema("file string").parquet(*paths) if paths else None


def _live_files(
    spark: SparkSession, root: str, event: T.StructType | None, fmt: str, days: list[Day] | None
) -> DataFrame:
    """Rows of all live files with ``generation``, ``file`` and ``bytes``."""
    _, generations, compacted = _pointer(spark, root)
    folders = ["generation=0"] if days is None else [_day_folder(0, day) for day in days]
    folders += [_day_folder(g, day) for day, g in compacted.items() if days is None or day in days]
    found = [f"{root}/{folder}" for folder in folders if files.exists(spark, f"{root}/{folder}")]
    schema = T.StructType([*archive_schema(event or event_schema()).fields, T.StructField("generation", T.IntegerType())])
    if not found:
        return spark.createDataFrame([], schema).withColumns({"file": F.lit(""), "bytes": F.lit(0).cast("bigint")})
    rows = spark.read.format(fmt).schema(schema).option("basePath", root).load(found)
    file = F.substring_index(F.col("_metadata.file_path"), "/generation=", -1)
    gone = _absorbed(spark, root, generations)
    names = None if gone is None else [r.file for r in gone.filter("file LIKE '0/%'").limit(SMALL_VALUES + 1).collect()]
    if names and len(names) <= SMALL_VALUES:
        # A literal list keeps absorbed files out of the scan.
        rows = rows.filter(~file.isin(names))
    rows = rows.select(*rows.columns, file.alias("file"), F.col("_metadata.file_size").alias("bytes"))
    if names and len(names) > SMALL_VALUES:
        rows = rows.join(broadcast_if_small(gone.filter("file LIKE '0/%'")), "file", "left_anti").select(rows.columns)
    return rows


def read_live(
    spark: SparkSession,
    root: str,
    event: T.StructType | None = None,
    fmt: str = "parquet",
    days: list[Day] | None = None,
) -> DataFrame:
    """The archive as of the newest pointer, with what was appended since; ``days`` lists only those days' folders."""
    return _live_files(spark, root.rstrip("/"), event, fmt, days).drop("generation", "file", "bytes")


def compact_days(
    spark: SparkSession,
    root: str,
    event: T.StructType | None = None,
    fmt: str = "parquet",
    target_bytes: int = TARGET_BYTES,
    slack: int = 0,
) -> list[Day]:
    """Rewrite the days that need it into a new generation, move the pointer, and return those days.

    A day needs it if it has appended files and one of its channels lies in more than ``slack`` files beyond what its
    bytes ask for. Files hold about ``target_bytes``, at the bytes a row of those days takes on average. An archive
    whose days were all rewritten is left as it is. One compaction runs at a time; a second one fails at the pointer.
    """
    root = root.rstrip("/")
    last, generations, compacted = _pointer(spark, root)
    path = scratch(spark, "files")
    rows = _live_files(spark, root, event, fmt, None)
    listed = rows.groupBy("generation", *CHANNEL_COLUMNS, "file").agg(
        F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("n_rows")
    )
    listed.write.parquet(path)
    listed = spark.read.schema(listed.schema).parquet(path)
    asked = F.ceil(F.sum("bytes") / target_bytes) + slack
    channels = listed.groupBy(*CHANNEL_COLUMNS).agg((F.count(F.lit(1)) > asked).alias("many"), F.min("generation").alias("first"))
    by_day = channels.groupBy(*DAY_COLUMNS).agg(F.max("many").alias("many"), F.min("first").alias("first"))
    days = sorted(tuple(r) for r in by_day.filter("many AND first = 0").select(*DAY_COLUMNS).collect())
    if not days:
        return []
    taken = listed.join(F.broadcast(spark.createDataFrame(days, "year int, month int, day int")), DAY_COLUMNS)
    n_bytes, n_rows = taken.agg(F.sum("bytes"), F.sum("n_rows")).first()
    numbers = [int(name.partition("=")[2]) for name in files.names(spark, root) if name.startswith("generation=")]
    generation = max(numbers) + 1
    # What was listed is what is rewritten: files that are appended meanwhile stay live beside it.
    taken.select("file").write.parquet(f"{root}/absorbed/generation={generation}")
    absorbed = _absorbed(spark, root, [generation])
    wanted = _live_files(spark, root, event, fmt, days).join(broadcast_if_small(absorbed), "file", "left_semi")
    target_rows = max(1, target_bytes * n_rows // max(1, n_bytes))
    write_archive(
        wanted.drop("generation", "file", "bytes"), f"{root}/generation={generation}", fmt, "errorifexists", target_rows
    )
    if files.newest(spark, f"{root}/live") != last:
        raise RuntimeError("another compaction has moved the pointer")
    moved = compacted | dict.fromkeys(days, generation)
    state = {"generations": [*generations, generation], "days": [[*day, g] for day, g in sorted(moved.items())]}
    files.write_json(spark, f"{root}/live", files.numbered(generation, 0), state)
    return days


def retire(spark: SparkSession, root: str) -> int:
    """Delete the files that rewrites have read, once no reader of an older pointer runs; returns how many there were."""
    root = root.rstrip("/")
    _, generations, _ = _pointer(spark, root)
    gone = _absorbed(spark, root, generations)
    count = 0
    for row in gone.toLocalIterator() if gone is not None else ():
        path = f"{root}/generation={unquote(row.file)}"
        if files.exists(spark, path):
            files.remove(spark, path)
            count += 1
    return count

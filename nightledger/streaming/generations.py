"""Channel state of a stream as generations of immutable files.

A generation says where everything known after a batch lies: the events of each recent batch, in a folder of that batch,
and the last earlier event of every channel, in hash buckets of the channel. A batch adds a folder with its own events.
When all events of a recent batch have become older than the state needs them one by one, that batch is folded into the
buckets: only buckets of channels that it holds are written anew, under the folder of the batch at hand; the others stay
where they are. What is written so follows the events of a batch, not how long events are kept.

The list of a generation's folders is a small file, renamed into place last. Nothing is ever written into a folder that
a generation names, so a reader of an older one loses no file; folders go when none of the last ``KEPT`` generations
names them. A batch that runs again starts from the generation before it and adds another attempt, which then counts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightledger.operators.state import EVENT_COLUMNS, latest_per_key
from nightledger.sources import files

BUCKETS = 64
KEPT = 20
GENERATIONS, RECENT, BASE = "generations", "recent", "base"
KEY = "event_key"
BUCKET = "bucket"


def state_schema(params: T.StructType) -> T.StructType:
    text = [T.StructField(n, T.StringType()) for n in (KEY, "source", "eventName", "eventId")]
    return T.StructType([*text, T.StructField("eventTimeStamp", T.TimestampType()), T.StructField("paramSet", params)])


def bucket_of() -> F.Column:
    return F.pmod(F.hash(KEY), F.lit(BUCKETS))


@dataclass
class Generation:
    """``recent``: folder, first and last time (microseconds) of each batch; ``base``: the folder of each bucket."""

    root: str
    newest: int | None = None
    recent: list[dict] = field(default_factory=list)
    base: dict[str, str] = field(default_factory=dict)

    def _read(self, spark: SparkSession, params: T.StructType, folders: list[str]) -> DataFrame:
        schema = state_schema(params)
        if not folders:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(*[f"{self.root}/{folder}" for folder in folders])

    def events(self, spark: SparkSession, params: T.StructType, since: int | None = None) -> DataFrame:
        """The events of recent batches; with ``since``, of those batches that reach that time."""
        folders = [r["folder"] for r in self.recent if since is None or r["last"] >= since]
        rows = self._read(spark, params, folders).filter(F.col("eventTimeStamp").isNotNull())
        return rows if since is None else rows.filter(F.unix_micros("eventTimeStamp") >= since)

    def earlier(self, spark: SparkSession, params: T.StructType, buckets: list[int] | None = None) -> DataFrame:
        """The last event per channel of the batches before the recent ones, in all or some buckets."""
        return self._read(spark, params, [f for b, f in self.base.items() if buckets is None or int(b) in buckets])

    def known(self, spark: SparkSession, params: T.StructType) -> DataFrame:
        return self.events(spark, params).unionByName(self.earlier(spark, params))


def read_generation(spark: SparkSession, root: str, below: int | None = None) -> Generation:
    """The newest generation, or the newest of a batch before ``below``; an empty one if there is none."""
    name = files.newest(spark, f"{root}/{GENERATIONS}", below)
    return Generation(root) if name is None else Generation(root, **files.read_json(spark, f"{root}/{GENERATIONS}/{name}"))


def newest_batch(spark: SparkSession, root: str) -> int | None:
    name = files.newest(spark, f"{root}/{GENERATIONS}")
    return None if name is None else int(name[:19])


def begin(spark: SparkSession, root: str, batch_id: int) -> tuple[Generation, str]:
    """The generation that a batch starts from, and the name of this attempt at it."""
    files.make_folder(spark, f"{root}/{GENERATIONS}")
    attempt = files.next_attempt(spark, f"{root}/{GENERATIONS}", batch_id)
    return read_generation(spark, root, below=batch_id), files.numbered(batch_id, attempt)


def finish(
    spark: SparkSession, before: Generation, name: str, params: T.StructType,
    first: int | None, last: int | None, lateness: int, kept: int = KEPT,
) -> Generation:
    """Write and point to the generation after the batch, whose events lie in ``recent/<name>``."""
    root = before.root
    recent = list(before.recent)
    if last is not None:
        recent.append({"folder": f"{RECENT}/{name}", "first": first, "last": last})
    newest = max((t for t in (before.newest, last) if t is not None), default=None)
    old = [r for r in recent if newest is not None and r["last"] < newest - lateness]
    base = dict(before.base)
    if old:
        leaving = Generation(root, recent=old).events(spark, params).withColumn(BUCKET, bucket_of())
        touched = sorted(row[0] for row in leaving.select(BUCKET).distinct().collect())
        all_known = leaving.drop(BUCKET).unionByName(before.earlier(spark, params, touched))
        state = latest_per_key(all_known).withColumn(BUCKET, bucket_of())
        state.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{root}/{BASE}/{name}")
        base |= {str(b): f"{BASE}/{name}/{BUCKET}={b}" for b in touched}
    after = Generation(root, newest, [r for r in recent if r not in old], base)
    written = {"newest": after.newest, "recent": after.recent, "base": after.base}
    files.write_json(spark, f"{root}/{GENERATIONS}", name, written)
    _forget(spark, root, kept)
    return after


def _forget(spark: SparkSession, root: str, kept: int) -> None:
    """Remove generations beyond the last ``kept``, and the folders that only they name."""
    all_names = files.names(spark, f"{root}/{GENERATIONS}")
    leaving, staying = all_names[:-kept], all_names[-kept:]
    if not leaving:
        return

    def named(name: str) -> set[str]:
        value = files.read_json(spark, f"{root}/{GENERATIONS}/{name}")
        return {r["folder"] for r in value["recent"]} | set(value["base"].values())

    used = set().union(*map(named, staying))
    for name in leaving:
        for folder in named(name) - used:
            files.remove(spark, f"{root}/{folder}")
        files.remove(spark, f"{root}/{GENERATIONS}/{name}")

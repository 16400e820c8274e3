"""Keyword values of many batches, folded into sorted runs so that a lookup stays cheap however many batches there were.

Below a root lie ``batches`` with a folder per batch id, ``runs`` with the runs that batches were folded into, and
``live`` with the pointers. A run is cut into hash buckets of the exposure, each sorted by exposure and keyword; the
newest pointer names the runs and the last batch that they hold. A fold takes the batches since then, and with them the
newest runs for as long as these hold fewer than twice their batches. Runs so halve in size from one to the next: a
lookup opens one bucket in each of about log2(batches) runs, and a row is written again about as often.

A pointer is renamed into place after everything else; a fold that dies before leaves a run that nobody reads. Rows are
kept as they came, beside their ``batch_id``, repeated ones too. Rows without an exposure are stored and read, but no
lookup asks for them. A batch may be written again, also by no rows, until it is folded.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nightledger.operators.sizes import SMALL_VALUES, few_values
from nightledger.sources import files
from nightledger.sources.tables import staged, write_keyword_values

BUCKETS = 64
BATCH = "batch_id"
ORDER = ["bucket", "exposure_id", "keyword", BATCH]


def _bucket_of(exposure: Column, buckets: int) -> Column:
    return F.pmod(F.hash(exposure), F.lit(buckets))


def _state(spark: SparkSession, root: str, name: str | None = None) -> dict:
    """What the newest pointer, or the one of that name, says."""
    name = name or files.newest(spark, f"{root}/live")
    return {"through": -1, "runs": []} if name is None else files.read_json(spark, f"{root}/live/{name}")


def _batches(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(name.partition("=")[2]) for name in files.names(spark, f"{root}/batches"))


def append(values: DataFrame, root: str, batch_id: int) -> None:
    """Store a batch; writing it again replaces it until it has been folded."""
    through = _state(values.sparkSession, root)["through"]
    if batch_id <= through:
        raise ValueError(f"batch {batch_id} is folded, as are all up to {through}")
    write_keyword_values(values, f"{root}/batches", batch_id)


def _open(spark: SparkSession, root: str, ids: list[int]) -> list[DataFrame]:
    folders = [f"{root}/batches/{BATCH}={i}" for i in ids]
    if not folders:
        return []
    rows = spark.read.option("basePath", f"{root}/batches").parquet(*folders)
    return [rows.withColumn(BATCH, F.col(BATCH).cast("long"))]


def _run(spark: SparkSession, root: str, run: dict, exposures: list[str] | None = None) -> DataFrame:
    """A run, or the buckets of it in which the exposures lie."""
    held = run["held"]
    if exposures is not None:
        asked = F.array_distinct(F.array(*[_bucket_of(F.lit(e), run["buckets"]) for e in exposures]))
        held = sorted(set(held) & set(spark.range(1).select(asked).first()[0]))
    schema = T.StructType.fromJson(run["schema"])
    if not held:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/runs/{run['name']}/bucket={b}" for b in held])


def fold(spark: SparkSession, root: str, left_open: int = 1, buckets: int = BUCKETS) -> dict | None:
    """Fold all batches but the last ``left_open``, which may still be written again. None if there is nothing to fold.

    One exposure may hold any part of the rows: tasks are ranges of bucket, exposure, keyword and batch.
    """
    last, state = files.newest(spark, f"{root}/live"), _state(spark, root)
    new = [i for i in _batches(spark, root) if i > state["through"]]
    new = new[: max(0, len(new) - left_open)]
    if not new:
        return None
    runs, count, parts = list(state["runs"]), len(new), _open(spark, root, new)
    while runs and runs[-1]["batches"] < 2 * count:
        run = runs.pop()
        count += run["batches"]
        parts.append(_run(spark, root, run))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    name = files.numbered(0 if last is None else int(last[:19]) + 1, 0)
    (
        rows.withColumn("bucket", _bucket_of(F.col("exposure_id"), buckets))
        .repartitionByRange(*ORDER)
        .sortWithinPartitions(*ORDER)
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(f"{root}/runs/{name}")
    )
    held = sorted(int(folder.partition("=")[2]) for folder in files.names(spark, f"{root}/runs/{name}"))
    run = {"name": name, "batches": count, "buckets": buckets, "held": held, "schema": rows.schema.jsonValue()}
    after = {"through": new[-1], "runs": [*runs, run]}
    files.make_folder(spark, f"{root}/live")
    files.write_json(spark, f"{root}/live", name, after)
    return after


def _read(spark: SparkSession, root: str, exposures: list[str] | None) -> DataFrame:
    state = _state(spark, root)
    parts = [_run(spark, root, run, exposures) for run in state["runs"]]
    parts += _open(spark, root, [i for i in _batches(spark, root) if i > state["through"]])
    if not parts:
        raise ValueError(f"no batch has been stored below {root}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read(spark: SparkSession, root: str) -> DataFrame:
    """All rows with their batch id, folded or not. A store without any batch cannot be read."""
    return _read(spark, root, None)


def lookup(spark: SparkSession, root: str, exposures: list[str]) -> DataFrame:
    """Keyword values of a few exposures, from their buckets and the batches not folded yet."""
    return _read(spark, root, exposures).filter(F.col("exposure_id").isin(*exposures))


def lookup_for(spark: SparkSession, root: str, requests: DataFrame, few: int = SMALL_VALUES) -> DataFrame:
    """Keyword values of every exposure in a request table: by bucket if these are few, else by a semi join with all rows.

    The exposures asked for are written to the shared folder, since they are counted and then joined.
    """
    asked = staged(requests.select("exposure_id").distinct())
    found = few_values(asked, "exposure_id", few)
    return lookup(spark, root, found) if found is not None else read(spark, root).join(asked, "exposure_id", "left_semi")


def retire(spark: SparkSession, root: str, kept: int = 2) -> list[str]:
    """Delete what none of the last ``kept`` pointers names: batches that they all hold as runs, older runs and pointers."""
    pointers = files.names(spark, f"{root}/live")
    leaving, staying = pointers[:-kept], [_state(spark, root, name) for name in pointers[-kept:]]
    if not staying:
        return []
    used = {run["name"] for state in staying for run in state["runs"]}
    through = min(state["through"] for state in staying)
    gone = [f"batches/{BATCH}={i}" for i in _batches(spark, root) if i <= through]
    gone += sorted({f"runs/{run['name']}" for name in leaving for run in _state(spark, root, name)["runs"] if run["name"] not in used})
    gone += [f"live/{name}" for name in leaving]
    for path in gone:
        files.remove(spark, f"{root}/{path}")
    return gone

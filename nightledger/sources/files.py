"""Small files in any folder that Spark reaches: pointers to data, written under a temporary name and renamed last."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.mkdirs(where)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder. Hidden and temporary ones are left out."""
    fs, where = _at(spark, folder)
    found = [status.getPath().getName() for status in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(name for name in found if name[0] not in "._")


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def read_json(spark: SparkSession, path: str) -> dict:
    fs, where = _at(spark, path)
    source = fs.open(where)
    try:
        return json.loads(bytes(source.readAllBytes()).decode())
    finally:
        source.close()


def write_json(spark: SparkSession, folder: str, name: str, value: dict) -> None:
    """A new file, which readers see whole or not at all. The name must not be taken."""
    fs, where = _at(spark, f"{folder}/{name}")
    _, temporary = _at(spark, f"{folder}/.{name}-{uuid.uuid4().hex}")
    out = fs.create(temporary)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    if not fs.rename(temporary, where):
        raise FileExistsError(f"{folder}/{name}")


def numbered(batch_id: int, attempt: int) -> str:
    """A name whose order is that of batches, and of attempts at one batch."""
    return f"{batch_id:019d}-{attempt:06d}"


def newest(spark: SparkSession, folder: str, below: int | None = None) -> str | None:
    """The last ``numbered`` name in a folder, or the last of a batch before ``below``."""
    found = [n for n in names(spark, folder) if below is None or int(n[:19]) < below]
    return found[-1] if found else None


def next_attempt(spark: SparkSession, folder: str, batch_id: int) -> int:
    own = [int(n[20:26]) for n in names(spark, folder) if int(n[:19]) == batch_id]
    return max(own, default=-1) + 1


def move(spark: SparkSession, source: str, target: str) -> None:
    """Move a file, making folders as needed; a file that an earlier try has moved already stays where it is."""
    fs, a = _at(spark, source)
    _, b = _at(spark, target)
    if not fs.exists(a) and fs.exists(b):
        return
    fs.mkdirs(b.getParent())
    if not fs.rename(a, b):
        raise OSError(f"{source} could not be moved to {target}")


def files_below(spark: SparkSession, folder: str) -> list[str]:
    """Paths below a folder of all its data files, relative to it, in order."""
    fs, where = _at(spark, folder)
    if not fs.exists(where):
        return []
    base, found, listed = fs.getFileStatus(where).getPath().toString(), [], fs.listFiles(where, True)
    while listed.hasNext():
        path = listed.next().getPath()
        if path.getName()[0] not in "._":
            found.append(path.toString().removeprefix(base).lstrip("/"))
    return sorted(found)

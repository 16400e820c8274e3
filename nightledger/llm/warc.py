"""WARC archives: a deterministic sharded writer and a reader, as a Spark data source.

Records are sorted by (page id, SHA-256 of the payload) and cut into shards of like numbers of records. The cuts come from
a sample that the hashes of the keys choose, so they follow from the data alone, not from how it lies in files; the sample
holds about ``PER_SHARD`` keys a shard (all keys of a small table), and only decides where shards begin. A shard is one task.
It writes its records in order, each a gzip member of its own, and begins a new file once the compressed size of the
current one has reached a limit. Headers, record ids, lengths and digests are made anew from the payload. The same rows
give the same bytes, however they are partitioned. Control characters of a url are percent-encoded in its header.

Of equal payloads of ``REVISIT_BYTES`` or more, the record with the smallest page id is a response; the others are
revisits that name it and hold no payload. Which rows are revisits is worked out over ids and digests only; that
answer travels as narrow rows through the same sort as the pages, and arrives right before the page it is for. So pages
are shuffled once, and no join carries a payload. Payloads that a third of the pages share are one row per task in the
aggregate that finds the smallest id, and Spark splits the join that follows.

Tasks write under temporary names of their own attempt. Only when all tasks are done are their files moved to the
final names; a manifest (file, records, compressed bytes, SHA-256) is written last, also under a temporary name first.
Readers follow the manifest, so they see all of an archive or none of it; a lost task's files are in no manifest and are
deleted at the end. Files are opened with pyarrow's file systems: every folder that both Spark and pyarrow reach will do.

Reading checks every length and digest and raises where one does not fit.

Nulls: a null html is an empty payload; a null url or id leaves its header out. A row without an id refers to a row that
has one, and is never referred to. Rows that share id and payload are each written, with equal types. Very long payloads
are compressed in one piece of a task's memory. An empty table gives an archive without files; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from nightledger.llm.registry import query
from nightledger.llm.tables import ready, written
from nightledger.session import scratch

REVISIT_BYTES = 100
PER_SHARD = 32
#: A shard holds so many bytes of payload at least, and at most once there are over ``FEW`` of them.
SMALL_SHARD, LARGE_SHARD, FEW = 8 << 20, 512 << 20, 1024
FILE_BYTES = 256 << 20
READ_BYTES = 8 << 20

DATE = "1970-01-01T00:00:00Z"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST, TEMPORARY = "manifest.jsonl", "_temporary"
END = b"\r\n\r\n"

RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return pa.fs.FileSystem.from_uri(path)


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}>"


def one_line(text: str) -> str:
    """A header value: control characters are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in text)


def headers(first: str, fields: list[tuple[str, object]]) -> bytes:
    lines = [first, *(f"{name}: {one_line(str(value))}" for name, value in fields if value is not None)]
    return "\r\n".join(lines).encode() + END


def http_headers(size: int) -> bytes:
    return headers("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", size)])


def page_record(page: int | None, url: str | None, payload: memoryview, digest: str, first: dict | None) -> list[bytes | memoryview]:
    """The parts of a response, or of a revisit of the page ``first`` names, from its payload."""
    if hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"page {page}: the payload is not what was hashed")
    block = [http_headers(len(payload))] + ([payload] if first is None else [])
    sha = hashlib.sha256()
    for part in block:
        sha.update(part)
    refers = [] if first is None else [
        ("WARC-Profile", SAME_PAYLOAD),
        ("WARC-Refers-To", record_id(first["refers_to"], digest)),
        ("WARC-Refers-To-Target-URI", first["target"]),
        ("WARC-Refers-To-Date", DATE),
        ("X-Refers-To-Page", first["refers_to"]),
    ]
    head = headers(
        "WARC/1.1",
        [
            ("WARC-Type", "response" if first is None else "revisit"),
            ("WARC-Record-ID", record_id(page, digest)),
            ("WARC-Date", DATE),
            ("WARC-Target-URI", url),
            ("X-Page", page),
            *refers,
            ("WARC-Payload-Digest", f"sha256:{digest}"),
            ("WARC-Block-Digest", f"sha256:{sha.hexdigest()}"),
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", sum(map(len, block))),
        ],
    )
    return [head, *block, END]


def info_record(name: str) -> list[bytes]:
    """The record a file begins with."""
    block = headers("software: nightledger", [("format", "WARC File Format 1.1")])
    digest = hashlib.sha256(block).hexdigest()
    head = headers(
        "WARC/1.1",
        [
            ("WARC-Type", "warcinfo"),
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'file:{name}')}>"),
            ("WARC-Date", DATE),
            ("WARC-Filename", name),
            ("WARC-Block-Digest", f"sha256:{digest}"),
            ("Content-Type", "application/warc-fields"),
            ("Content-Length", len(block)),
        ],
    )
    return [head, block, END]


class Rolling:
    """Files of one shard under temporary names; a new one begins when the current one has reached the limit."""

    def __init__(self, folder: str, stem: str, attempt: str, limit: int, level: int):
        self.fs, self.folder = opened(folder)
        self.stem, self.attempt, self.limit, self.level = stem, attempt, limit, level
        self.files: list[dict] = []
        self.out = None

    def add(self, parts: list) -> None:
        if self.out is None:
            self.begin()
        self.member(parts)
        self.records += 1
        if self.size >= self.limit:
            self.end()

    def begin(self) -> None:
        name = f"{self.stem}-{len(self.files):05d}.warc.gz"
        self.name, self.temporary = name, f"{self.attempt}-{name}"
        self.size = self.records = 0
        self.sha = hashlib.sha256()
        self.out = self.fs.open_output_stream(f"{self.folder}/{self.temporary}", compression=None)
        self.member(info_record(name))

    def member(self, parts: list) -> None:
        gzip = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        for piece in [*map(gzip.compress, parts), gzip.flush()]:
            self.out.write(piece)
            self.sha.update(piece)
            self.size += len(piece)

    def end(self) -> None:
        if self.out is not None:
            self.out.close()
            entry = {"file": self.name, "records": self.records, "bytes": self.size, "sha256": self.sha.hexdigest()}
            self.files.append(entry | {"temporary": self.temporary})
            self.out = None


class Writer(DataSourceArrowWriter):
    """Writes rows sorted by page, digest and kind; a row of kind 0 says what the pages after it refer to."""

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.limit = int(options.get("fileBytes", FILE_BYTES))
        self.level = int(options.get("level", 6))
        self.job = uuid.uuid4().hex
        fs, path = opened(self.path)
        there = fs.get_file_info(f"{path}/{MANIFEST}").type != pa.fs.FileType.NotFound
        if there and not overwrite:
            raise ValueError(f"{self.path} holds an archive")
        fs.create_dir(f"{path}/{TEMPORARY}/{self.job}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        task = TaskContext.get()
        shard = f"pages-{task.partitionId():06d}"
        rolling = Rolling(f"{self.path}/{TEMPORARY}/{self.job}", shard, str(task.taskAttemptId()), self.limit, self.level)
        key, first = None, None
        for batch in iterator:
            narrow = batch.select(["page_id", "digest", "kind", "url", "refers_to", "target"]).to_pylist()
            html = batch.column("html")
            for i, row in enumerate(narrow):
                if (row["page_id"], row["digest"]) != key:
                    key, first = (row["page_id"], row["digest"]), None
                if row["kind"] == 0:
                    first = row
                    continue
                payload = memoryview(html[i].as_buffer()) if html[i].is_valid else memoryview(b"")
                rolling.add(page_record(row["page_id"], row["url"], payload, row["digest"], first))
        rolling.end()
        message = WriterCommitMessage()
        message.files = rolling.files
        return message

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, path = opened(self.path)
        own = f"{path}/{TEMPORARY}/{self.job}"
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f["file"])
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda f: fs.move(f"{own}/{f['temporary']}", f"{path}/{f['file']}"), files))
        lines = [json.dumps({k: v for k, v in f.items() if k != "temporary"}) for f in files]
        with fs.open_output_stream(f"{own}/{MANIFEST}", compression=None) as out:
            out.write("".join(f"{line}\n" for line in lines).encode())
        fs.move(f"{own}/{MANIFEST}", f"{path}/{MANIFEST}")
        fs.delete_dir(own)
        listed = {f["file"] for f in files}
        for old in fs.get_file_info(pa.fs.FileSelector(path)):
            if old.base_name.endswith(".warc.gz") and old.base_name not in listed:
                fs.delete_file(old.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, path = opened(self.path)
        fs.delete_dir(f"{path}/{TEMPORARY}/{self.job}")


def members(source: pa.NativeFile) -> Iterator[bytes]:
    """The uncompressed gzip members of a file, one after the other."""
    rest = b""
    while chunk := rest or source.read(1 << 20):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if not chunk:
                raise ValueError("a record ends early")
            parts.append(member.decompress(chunk))
            chunk = b"" if member.eof else source.read(1 << 20)
        rest = member.unused_data
        yield b"".join(parts)


def fields_of(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def page_of(record: bytes) -> tuple | None:
    """A page's row from a record, checked against its digests; None for records of other types."""
    head, _, rest = record.partition(END)
    fields = fields_of(head)
    size = int(fields["Content-Length"])
    block = rest[:size]
    if rest[size:] != END or f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"{fields['WARC-Record-ID']}: the block is not what was written")
    if fields["WARC-Type"] not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(END)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    length = int(fields_of(http)["Content-Length"])
    if fields["WARC-Type"] == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload is not what was written")
    page, refers = fields.get("X-Page"), fields.get("X-Refers-To-Page")
    return (
        None if page is None else int(page),
        fields.get("WARC-Target-URI"),
        fields["WARC-Type"],
        None if refers is None else int(refers),
        digest,
        length,
        payload if fields["WARC-Type"] == "response" else None,
    )


class Reader(DataSourceReader):
    """One partition for about ``READ_BYTES`` of compressed files, as the manifest lists them."""

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.payload = options.get("payload", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        fs, path = opened(self.path)
        with fs.open_input_stream(f"{path}/{MANIFEST}", compression=None) as source:
            files = [json.loads(line) for line in source.read().splitlines()]
        groups: list[list[str]] = []
        size = READ_BYTES
        for f in files:
            if size + f["bytes"] > READ_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(f["file"])
            size += f["bytes"]
        return [InputPartition(group) for group in groups] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        fs, path = opened(self.path)
        names = [c.split()[0] for c in RECORDS.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=names)

        for name in partition.value:
            with fs.open_input_stream(f"{path}/{name}", compression=None) as source:
                for row in filter(None, map(page_of, members(source))):
                    held += len(row[-1] or b"") if self.payload else 0
                    rows.append(row if self.payload else (*row[:-1], None))
                    if held >= READ_BYTES or len(rows) >= 10_000:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


class Warc(DataSource):
    """``warc``: options path, fileBytes and level for writing; path and payload (true or false) for reading."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORDS

    def writer(self, schema: object, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(self.options, overwrite)

    def reader(self, schema: object) -> DataSourceReader:
        return Reader(self.options)


def revisits(narrow: DataFrame) -> DataFrame:
    """page_id, digest, refers_to and the url it had, for the rows of equal payloads that are not the first."""
    large = narrow.filter(F.col("size") >= REVISIT_BYTES)
    named = F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))
    firsts = large.groupBy("digest").agg(F.min(named).alias("first"), F.count(F.lit(1)).alias("n"))
    shared = firsts.filter((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first")
    others = large.join(shared, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first.page_id")))
    return others.select("page_id", "digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("target"))


def shards_for(size: int) -> int:
    return max(1, math.ceil(size / min(max(size / FEW, SMALL_SHARD), LARGE_SHARD)))


def shard_cuts(narrow: DataFrame, shards: int, rows: int) -> list[dict]:
    """The first keys of all shards but the first, by a sample of about ``PER_SHARD`` keys a shard."""
    whole = 1 << 30
    chosen = F.pmod(F.xxhash64("page_id", "digest"), F.lit(whole)) < min(whole, -(-whole * PER_SHARD * shards // max(rows, 1)))
    sample = narrow.filter(chosen).groupBy("page_id", F.substring("digest", 1, 16).alias("digest")).count()
    keys = sample.orderBy("page_id", "digest").collect()
    total, seen, cuts = sum(k["count"] for k in keys), 0, []
    for k in keys:
        if seen * shards >= total * (len(cuts) + 1):
            cuts.append({"page_id": k["page_id"], "digest": k["digest"]})
        seen += k["count"]
    return cuts


def shard_of(cuts: list[dict], kind: str) -> Column:
    """How many cuts are at or before a row's key, by a search in two steps."""
    if not cuts:
        return F.lit(0)
    wide = math.isqrt(len(cuts) - 1) + 1
    rows = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    key = f"struct<page_id:{kind},digest:string>"
    heads = F.from_json(F.lit(json.dumps([r[0] for r in rows])), f"array<{key}>")
    inner = F.from_json(F.lit(json.dumps(rows)), f"array<array<{key}>>")
    own = F.struct(F.col("page_id"), F.substring("digest", 1, 16).alias("digest"))
    row = F.size(F.filter(heads, lambda c: c <= own)) - 1
    return F.when(row < 0, 0).otherwise(row * wide + F.size(F.filter(F.get(inner, row), lambda c: c <= own)))


def write_warc(pages: DataFrame, path: str, id_column: str = "page_id", url: str = "url", html: str = "html", file_bytes: int = FILE_BYTES, level: int = 6) -> None:
    """The pages as an archive in ``path``; an archive that is there already is replaced when the new one is whole."""
    spark = pages.sparkSession
    spark.dataSource.register(Warc)
    payload = F.coalesce(F.col(html).cast("string"), F.lit(""))
    whole = pages.select(F.col(id_column).cast("long").alias("page_id"), F.sha2(payload, 256).alias("digest"), F.col(url).alias("url"), payload.alias("html"))
    narrow = written(whole.select("page_id", "digest", "url", F.octet_length("html").cast("long").alias("size")), "payloads")
    rows, size = narrow.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    shards = shards_for(size)
    shard = shard_of(shard_cuts(narrow, shards, rows), "bigint").cast("int")
    told = revisits(narrow).withColumn("kind", F.lit(0))
    both = whole.withColumn("kind", F.lit(1)).unionByName(told, allowMissingColumns=True)
    dealt = both.repartitionById(shards, shard).sortWithinPartitions("page_id", "digest", "kind")
    options = {"path": path, "fileBytes": file_bytes, "level": level}
    dealt.write.format("warc").options(**options).mode("overwrite").save()


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The page records of an archive; ``payload`` is null for revisits, and for all rows where it is not asked for."""
    spark.dataSource.register(Warc)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


@query(
    "op12_warc",
    """
    WITH p AS (
      SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha256(coalesce(html, '')) AS d FROM pages
    ), f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS low FROM p)
    SELECT page_id, n AS payload_bytes, d AS payload_digest,
           CASE WHEN low IS NOT NULL AND page_id IS DISTINCT FROM low THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id IS DISTINCT FROM low THEN low END AS refers_to
    FROM f
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(ready(spark), "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    rows = read_warc(spark, path, payload=False)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

"""Suffix-array dedup: bytes covered by a 50-byte string that also starts in a document with a smaller id are removed.

How strings are brought together is in ``anchors``. A shard sorts the positions of its segments by bucket-pointer
refinement: buckets of equal 8-byte q-grams are refined by the bucket pointers of positions 8, 16 and then 18 bytes
further on, so that equal pointers mean 50 equal bytes. The smallest document id of a bucket answers for its windows.

Nulls: a null text is empty; a document without an id counts as larger than any other and its id comes back null.
Documents that share an id do not remove from each other. Texts shorter than 50 bytes, empty ones and empty tables lose
nothing. Other columns of the input are not touched. A long text is one row of a block and stays within a task's memory.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from nightledger.llm.anchors import NO_ID, Shape, Symbols, dedup, first_of, range_marks, refined, spread
from nightledger.llm.registry import query
from nightledger.llm.tables import documents
from nightledger.llm.words import flat, mixed

LENGTH, QGRAM = 50, 8

#: Anchors are of so many bytes: long enough to be rare unless a passage is repeated.
ANCHOR = 27

#: A number for every byte, so that sums of them tell strings apart.
BYTE_MARKS = mixed(np.arange(1, 257))


def read(texts: pa.Array) -> Symbols:
    data, at = flat(texts)
    return Symbols(BYTE_MARKS[data], at, data, np.arange(len(data) + 1), 0)


def least_ids(raw: np.ndarray, sizes: np.ndarray, lows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a shard's segments: which of its different ones each is, and the smallest id of every window of those."""
    begin = np.cumsum(sizes) - sizes
    first, number = first_of(range_marks(BYTE_MARKS[raw], begin, sizes), sizes)
    low = np.full(len(first), NO_ID, np.int64)
    np.minimum.at(low, number, lows)
    sizes = sizes[first]
    data = raw[spread(begin[first], sizes)]
    padded = np.concatenate([data, np.zeros(QGRAM, np.uint8)]).astype(np.uint64)
    keys = np.zeros(len(data), np.uint64)
    for j in range(QGRAM):
        keys = (keys << np.uint64(8)) | padded[j : j + len(data)]
    windows = sizes - LENGTH + 1
    starts = spread(np.cumsum(sizes) - sizes, windows)
    wanted = np.zeros(len(data), bool)
    wanted[starts] = True
    pointer, _ = refined(keys, QGRAM, LENGTH, wanted)
    bucket = pointer[starts]
    least = np.full(len(data), NO_ID, np.int64)
    np.minimum.at(least, bucket, np.repeat(low, windows))
    return number, least[bucket]


def result(digests: bool):
    def finish(block: pa.Table, symbols: Symbols, removed: np.ndarray) -> pa.Table:
        edges = removed.astype(np.int8)
        edges[1:] -= removed[:-1].astype(np.int8)
        inner = symbols.at[:-1][symbols.at[:-1] < len(removed)]
        edges[inner] = removed[inner]
        rows = []
        for i, (doc, unnamed) in enumerate(zip(block["doc"].to_pylist(), block["unnamed"].to_pylist(), strict=True)):
            a, b = symbols.at[i], symbols.at[i + 1]
            gone = removed[a:b]
            kept = symbols.raw[a:b][~gone].tobytes()
            begins = np.flatnonzero(edges[a:b] == 1)
            row = (None if unnamed else doc, int(b - a), int(gone.sum()), len(begins))
            if digests:
                rows.append((*row, hashlib.sha256(kept).hexdigest()))
            else:
                ends = np.flatnonzero(gone & ~np.concatenate([gone[1:], [False]])) + 1
                rows.append((*row, begins.tolist(), ends.tolist(), kept))
        kinds = [pa.int64()] * 4 + ([pa.string()] if digests else [pa.list_(pa.int64())] * 2 + [pa.binary()])
        names = ["doc_id", "n_bytes", "n_removed", "n_spans"] + (["kept_sha256"] if digests else ["span_starts", "span_ends", "kept"])
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return finish


def remove_repeated_bytes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, and the removed spans with the bytes that stay, or the digest of those."""
    columns = "kept_sha256 string" if digests else "span_starts array<long>, span_ends array<long>, kept binary"
    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, {columns}"
    shape = Shape(LENGTH, ANCHOR, read)
    return dedup(docs, id_column, text, shape, least_ids, result(digests), schema)


@query(
    "op3_suffix_array_dedup",
    """
    WITH b AS (
      SELECT doc_id, unnest(bytes) AS byte, generate_subscripts(bytes, 1) AS place
      FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS bytes FROM documents)
    ), v AS (
      SELECT *, string_agg(byte, '') OVER ahead AS seen, count(*) OVER ahead = 50 AS whole
      FROM b WINDOW ahead AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)
    ), l AS (SELECT seen, min(doc_id) AS low FROM v WHERE whole GROUP BY seen),
    g AS (
      SELECT v.doc_id, place, byte, coalesce(bool_or(low < v.doc_id) OVER (
               PARTITION BY v.doc_id ORDER BY place ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone
      FROM v LEFT JOIN l ON whole AND v.seen = l.seen
    ), s AS (SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY place) AS starts FROM g),
    k AS (
      SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS gone, count(*) FILTER (starts) AS spans,
             string_agg(byte, '' ORDER BY place) FILTER (NOT gone) AS kept
      FROM s GROUP BY doc_id
    )
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
           sha256(unhex(coalesce(kept, ''))) AS kept_sha256
    FROM documents d LEFT JOIN k USING (doc_id)
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(documents(spark, sf_dir), digests=True)

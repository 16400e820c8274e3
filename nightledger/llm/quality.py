"""Quality rules: counts per document, and lines that recur over many documents of a host.

Lines are normalised (A-Z in lower case, digits as 0, white space as one space) and hashed. A line is frequent on its
host when it stands in at least ``MIN_DOCS`` different texts and in ``SHARE`` of all different texts of the host; equal
texts count once, so that copies of one document do not condemn each other. A document from which frequent lines take
so much that fewer than ``LEFT_WORDS`` words or less than ``LEFT_SHARE`` of its words are left is depleted and rejected.
``keep_good`` takes the frequent lines out of the documents that are kept; lines without words stay.

The documents' line hashes are a small table (no texts). Copies of a text are reduced before lines are counted; counts
are partial before they are shuffled. Frequent lines meet their documents by a join that Spark splits when it is hot.

Nulls: a null text has no words and fails the base rule; a null host is a host of its own. Repeated rows are judged one
by one and equally. Very long texts are counted in one piece of a task's memory. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from nightledger.llm.registry import query
from nightledger.llm.tables import documents, unused_prefix, written
from nightledger.llm.words import Words, flat, grams, slices, sums

MIN_WORDS, REPEATED_PERCENT, WINDOW = 10, 20, 5
MIN_DOCS, SHARE = 5, 0.05
LEFT_WORDS, LEFT_SHARE = 10, 0.2

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", b"abcdefghijklmnopqrstuvwxyz0000000000")

#: The white space between words.
BLANK = b" \t\n\v\f\r"

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: Words) -> np.ndarray:
    """For each text, its words in windows of five words that it has twice or more."""
    ids = words.ids()
    mark = grams(ids, WINDOW)
    inside = words.text[: len(mark)] == words.text[WINDOW - 1 :][: len(mark)]
    at = np.flatnonzero(inside)
    order = at[np.lexsort((mark[at], words.text[at]))]
    same = (mark[order][1:] == mark[order][:-1]) & (words.text[order][1:] == words.text[order][:-1])
    for j in range(WINDOW):  # the marks only bring equal windows together
        same &= ids[order[1:] + j] == ids[order[:-1] + j]
    twice = np.concatenate([order[1:][same], order[:-1][same]])
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, twice, 1)
    run = np.cumsum(cover)
    covered = run[: len(ids)].copy()
    covered[WINDOW:] -= run[: max(0, len(ids) - WINDOW)]
    return sums(covered > 0, words.first)


def line_rows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text of every line that has a word."""
    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([at[:-1], breaks + 1]))
    begin = begin[begin < len(data)] if len(data) else begin[:0]
    begin = np.unique(begin)
    end = np.concatenate([begin[1:], [len(data)]])[: len(begin)]
    end = end - (data[end - 1] == 10)
    return begin, end, np.searchsorted(at, begin, "right") - 1


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            data, at = flat(batch.column("text"))
            words = Words(data, at)
            letters = ~words.space & ((data & 0xC0) != 0x80)
            begin, end, text = line_rows(data, at)
            n = np.searchsorted(words.start, end) - np.searchsorted(words.start, begin)
            begin, end, text, n = (x[n > 0] for x in (begin, end, text, n))
            raw, repeats, hashes, sizes = data.tobytes(), np.zeros(len(at) - 1, np.int64), [], []
            first = np.searchsorted(text, np.arange(len(at)))
            for i in range(len(at) - 1):
                lines = [raw[begin[k] : end[k]] for k in range(first[i], first[i + 1])]
                repeats[i] = len(lines) - len(set(lines))
                own: dict[int, int] = {}
                for line, k in zip(lines, range(first[i], first[i + 1]), strict=True):
                    mark = line_mark(line)
                    own[mark] = own.get(mark, 0) + int(n[k])
                hashes.append(list(own))
                sizes.append(list(own.values()))
            columns = {
                "n_words": np.diff(words.first),
                "word_chars": sums(letters, at),
                "n_symbols": sums(SYMBOLS[data], at),
                "n_dup_lines": repeats,
                "n_repeat_words": repeated_words(words),
            }
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept]
                + [pa.array(x, pa.int64()) for x in columns.values()]
                + [pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int64()))],
                names=[*kept, *columns, "lines", "line_words"],
            )


def line_mark(line: bytes) -> int:
    """The hash of a line, normalised."""
    digest = hashlib.blake2b(b" ".join(line.translate(PLAIN).split()), digest_size=8).digest()
    return int.from_bytes(digest, "little", signed=True)


def line_frequency(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", host: str = "source",
    min_docs: int = MIN_DOCS, share: float = SHARE, left_words: int = LEFT_WORDS, left_share: float = LEFT_SHARE,
) -> DataFrame:
    """For every row: id, row (its number in this run), host, mark of the text, the counts, base_failed, kept,
    n_frequent_words, and frequent, the hashes of its frequent lines (null where it has none)."""
    named = docs.select(
        F.col(id_column).cast("long").alias("id"),
        F.monotonically_increasing_id().alias("row"),
        host_label(host).alias("host"),
        F.xxhash64(F.col(text)).alias("mark"),
        F.col(text).alias("text"),
    )
    schema = f"id long, row long, host string, mark long, {COUNTS}, lines array<long>, line_words array<long>"
    table = written(named.mapInArrow(measured, schema), "lines")

    texts = table.dropDuplicates(["host", "mark"])
    hosts = texts.groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    counts = texts.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    frequent = counts.filter(F.col("n") >= min_docs).join(hosts, "host").filter(F.col("n") >= share * F.col("docs"))
    taken = (
        table.select("row", "host", F.explode(F.arrays_zip("lines", "line_words")).alias("l"))
        .select("row", "host", F.col("l.lines").alias("line"), F.col("l.line_words").alias("w"))
        .join(frequent.select("host", "line"), ["host", "line"], "left_semi")
        .groupBy("row")
        .agg(F.sum("w").alias("n_frequent_words"), F.collect_list("line").alias("frequent"))
    )
    judged = table.drop("lines", "line_words").join(taken, "row", "left").fillna(0, ["n_frequent_words"])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    left = F.col("n_words") - F.col("n_frequent_words")
    depleted = (F.col("n_frequent_words") > 0) & ((left < left_words) | (left < left_share * F.col("n_words")))
    return judged.withColumns({"base_failed": failed, "kept": ~failed & ~depleted})


def host_label(host: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(host)), F.lit(""))


def without_lines(text: str, column: str):
    """Rows with a text and hashes of lines in ``column``: the text without these lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = flat(batch.column(text))
            raw, texts = data.tobytes(), []
            for i, frequent in enumerate(batch.column(column).to_pylist()):
                own = raw[at[i] : at[i + 1]]
                if frequent:
                    gone = set(frequent)
                    own = b"\n".join(x for x in own.split(b"\n") if not x.strip(BLANK) or line_mark(x) not in gone)
                texts.append(own.decode("utf-8", "replace"))
            names = [c for c in batch.schema.names if c != column]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else batch.column(c) for c in names], names=names)

    return run


def keep_good(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", host: str = "source", n_chars: str = "n_chars"
) -> DataFrame:
    """The rows of ``docs`` that the rules keep, without the lines that are frequent on their host.

    Where a row has lost lines its ``n_chars``, if there is such a column, is counted anew. Nothing else changes.
    """
    own = unused_prefix(docs)
    keys, frequent, cut = [own + k for k in ("id", "host", "mark")], own + "frequent", own + "shorter"
    judged = line_frequency(docs, id_column, text, host=host).filter("kept")
    good = judged.select(*(F.col(k[len(own) :]).alias(k) for k in keys), F.col("frequent").alias(frequent)).dropDuplicates(keys)
    same = F.col(id_column).eqNullSafe(F.col(keys[0])) & (host_label(host) == F.col(keys[1])) & (F.xxhash64(F.col(text)) == F.col(keys[2]))
    kept = docs.join(good, same).select(docs["*"], frequent)
    if n_chars not in docs.columns:
        return kept.mapInArrow(without_lines(text, frequent), docs.schema)
    shorter = kept.withColumn(cut, F.col(frequent).isNotNull())
    schema = StructType([*docs.schema.fields, StructField(cut, BooleanType())])
    out = shorter.select(*docs.columns, cut, frequent).mapInArrow(without_lines(text, frequent), schema)
    counted = F.when(F.col(cut), F.length(text)).otherwise(F.col(n_chars))
    return out.withColumn(n_chars, counted.cast(docs.schema[n_chars].dataType)).drop(cut)


WORD = r"[^\x20\x09-\x0D]+"


@query(
    "op9_quality_rules",
    f"""
    WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS words, string_split(text, chr(10)) AS lines FROM d),
    g AS (
      SELECT doc_id, i, array_to_string(words[i : i + 4], ' ') AS gram
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)
    ),
    r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
    c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM r, range(0, 5) AS x(j) GROUP BY doc_id),
    l AS (
      SELECT doc_id, host, text, line, regexp_extract_all(line, '{WORD}') AS lw
      FROM (SELECT doc_id, host, text, unnest(lines) AS line FROM w)
    ),
    u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE len(lw) > 0 GROUP BY doc_id),
    n AS (
      SELECT doc_id, host, text, len(lw) AS k,
             translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789',
                       'abcdefghijklmnopqrstuvwxyz0000000000') AS line
      FROM l WHERE len(lw) > 0
    ),
    h AS (SELECT host, count(DISTINCT text) AS docs FROM d GROUP BY host),
    f AS (
      SELECT n.host, n.line FROM n JOIN h ON n.host = h.host GROUP BY n.host, n.line, h.docs
      HAVING count(DISTINCT n.text) >= {MIN_DOCS} AND count(DISTINCT n.text) >= {SHARE} * h.docs
    ),
    t AS (SELECT doc_id, sum(k)::BIGINT AS n FROM n SEMI JOIN f USING (host, line) GROUP BY doc_id),
    a AS (
      SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(u.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, coalesce(t.n, 0) AS gone
      FROM w LEFT JOIN u USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
    ),
    b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEATED_PERCENT} * n_words AS base_failed FROM a)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT (gone > 0 AND (n_words - gone < {LEFT_WORDS} OR n_words - gone < {LEFT_SHARE} * n_words)) AS kept,
           gone::BIGINT AS n_frequent_words
    FROM b
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_frequent_words",
    )

"""Substring dedup over words: words in a window of 13 that also starts in a document with a smaller id are removed.

How windows are brought together is in ``anchors``. Each shard holds a compressed FM-index of its segments: the
Burrows-Wheeler transform of their word numbers as a wavelet matrix of packed bits. All windows of the shard's segments
are streamed through it by backward search, one word after the other from the last to the first: the interval of
suffixes that is left after 13 words are the places where the window stands, so a matching statistic reaches the
threshold wherever an interval remains. The smallest document id in the interval answers for the window. A window whose
interval has shrunk to one place stands nowhere else and is not followed further.

Word numbers are exact in a shard (words are compared as bytes). Nulls: a null text has no words; a document without an
id counts as larger than any other and its id comes back null. Documents that share an id do not remove from each
other. Documents of fewer than 13 words and empty tables lose nothing. Other columns of the input are not touched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from nightledger.llm.anchors import NO_ID, Shape, Symbols, dedup, first_of, range_marks, refined, spread
from nightledger.llm.registry import query
from nightledger.llm.tables import documents
from nightledger.llm.words import Words, flat, mixed, word_marks

WINDOW = 13

#: Windows that are searched at a time.
STREAM = 1 << 16


def read(texts: pa.Array) -> Symbols:
    """Words as symbols; in ``raw`` each is followed by one space."""
    words = Words(*flat(texts))
    sizes = words.end - words.start
    marks = word_marks(words.data, words.start, words.end)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    raw = np.full(int(begin[-1]), 0x20, np.uint8)
    keep = np.ones(len(raw), bool)
    keep[begin[1:] - 1] = False
    raw[keep] = words.data[~words.space]
    return Symbols(marks, words.first, raw, begin, 1)


class Wavelet:
    """Symbols by bit, the highest first; at each level those with a 0 stand before those with a 1."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = []
        for level in reversed(range(max(1, top.bit_length()))):
            bit = (symbols >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            words = np.zeros(len(symbols) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])
            zeros = int(len(symbols) - bit.sum())
            self.levels.append((level, words, before, zeros))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        every = np.arange(top + 1)
        self.base = self.down(every, np.zeros(len(every), np.int64))

    def down(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        for level, words, before, zeros in self.levels:
            word = places >> 6
            ones = before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)))
            places = np.where((symbols >> level) & 1, zeros + ones, places - ones)
        return places

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        return self.down(symbols, places) - self.base[symbols]


class FMIndex:
    """Of a text whose symbols are 0 (between segments) to top, for patterns of up to ``depth`` symbols without 0."""

    def __init__(self, text: np.ndarray, top: int, depth: int):
        self.text = text
        n, bits = len(text), max(1, int(top).bit_length())
        take = max(1, 62 // bits)
        padded = np.concatenate([text, np.zeros(take, np.int64)])
        keys = np.zeros(n, np.int64)
        for j in range(take):
            keys = (keys << bits) | padded[j : j + n]
        _, self.suffixes = refined(keys, take, max(depth, take))
        self.wavelet = Wavelet(text[self.suffixes - 1], top)
        counts = np.bincount(text, minlength=top + 1)
        self.before = np.concatenate([[0], np.cumsum(counts)])

    def back(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with one more symbol in front."""
        both = self.wavelet.rank(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        return self.before[symbols] + both[: len(low)], self.before[symbols] + both[len(low) :]


class LeastOf:
    """The smallest value of any interval, by the smallest ones of intervals of 1, 2, 4, ... places."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.empty(len(low), np.int64)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.levels[k][low[at]], self.levels[k][high[at] - (1 << int(k))])
        return out


def least_ids(raw: np.ndarray, sizes: np.ndarray, lows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a shard's segments: which of its different ones each is, and the smallest id of every window of those."""
    gaps = np.flatnonzero(raw == 0x20)
    ends = np.concatenate([[0], gaps + 1]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(gaps), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    begin = np.cumsum(sizes) - sizes
    first, number = first_of(range_marks(mixed(ids), begin, sizes), sizes)
    low = np.full(len(first), NO_ID, np.int64)
    np.minimum.at(low, number, lows)
    begin, sizes = begin[first], sizes[first]
    own = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int((sizes + 1).sum()), np.int64)
    text[spread(own, sizes)] = ids[spread(begin, sizes)]
    index = FMIndex(text, int(ids.max()), WINDOW)
    owner = np.repeat(low, sizes + 1)
    least = LeastOf(owner[index.suffixes])
    windows = sizes - WINDOW + 1
    starts, answer = spread(own, windows), np.repeat(low, windows)
    for a in range(0, len(starts), STREAM):
        place = starts[a : a + STREAM]
        at = np.arange(a, a + len(place))
        last = text[place + WINDOW - 1]
        left, right = index.before[last], index.before[last + 1]
        for step in range(WINDOW - 2, -1, -1):
            left, right = index.back(text[place + step], left, right)
            more = right - left > 1
            if not more.all():
                place, at, left, right = place[more], at[more], left[more], right[more]
        answer[at] = least(left, right)
    return number, answer


def result(digests: bool):
    def finish(block: pa.Table, symbols: Symbols, removed: np.ndarray) -> pa.Table:
        sizes = np.diff(symbols.begin)
        rows = []
        for i, (doc, unnamed) in enumerate(zip(block["doc"].to_pylist(), block["unnamed"].to_pylist(), strict=True)):
            a, b = symbols.at[i], symbols.at[i + 1]
            gone = removed[a:b]
            kept = symbols.raw[symbols.begin[a] : symbols.begin[b]][np.repeat(~gone, sizes[a:b])].tobytes()[:-1]
            row = (None if unnamed else doc, int(b - a), int(gone.sum()))
            rows.append((*row, hashlib.sha256(kept).hexdigest()) if digests else (*row, kept))
        kinds = [pa.int64()] * 3 + [pa.string() if digests else pa.binary()]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256" if digests else "kept"]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return finish


def remove_repeated_words(docs: DataFrame, id_column: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, and the words that stay joined by one space (as bytes), or their digest."""
    schema = f"doc_id long, n_words long, n_removed long, {'kept_sha256 string' if digests else 'kept binary'}"
    return dedup(docs, id_column, text, Shape(WINDOW, WINDOW - 7, read), least_ids, result(digests), schema)


@query(
    "op1_substring_dedup",
    """
    WITH w AS (
      SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place
      FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM documents)
    ), v AS (
      SELECT *, string_agg(word, ' ') OVER ahead AS seen, count(*) OVER ahead = 13 AS whole
      FROM w WINDOW ahead AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
    ), l AS (SELECT seen, min(doc_id) AS low FROM v WHERE whole GROUP BY seen),
    g AS (
      SELECT v.doc_id, place, word, coalesce(bool_or(low < v.doc_id) OVER (
               PARTITION BY v.doc_id ORDER BY place ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), false) AS gone
      FROM v LEFT JOIN l ON whole AND v.seen = l.seen
    ), k AS (
      SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS gone, string_agg(word, ' ' ORDER BY place) FILTER (NOT gone) AS kept
      FROM g GROUP BY doc_id
    )
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM documents d LEFT JOIN k USING (doc_id)
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(documents(spark, sf_dir), digests=True)

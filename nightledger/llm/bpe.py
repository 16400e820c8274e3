"""Byte-level BPE encoding and decoding by a reduction over a tree.

A text is cut by the vocabulary's pattern and each match is encoded by itself. A match is cut into leaves of at most
``LEAF`` bytes, which are merged directly; two neighbours L and R are joined by encoding a window around the boundary
anew. The window starts with one token of each side and doubles on a side as long as the token outside it and the
first one inside are not a stable pair. A pair (x, y) is stable when the bytes of both, encoded together, give x, y
again. A sequence whose neighbours are all stable is the encoding of its bytes, so tokens outside the window stand.
Leaves bound the cost of a long match: nothing is merged over more bytes than a window needs.

Decoding concatenates halves up a tree of the ids.

Nulls: a null text is empty and has no ids. Rows are encoded one by one, so repeated rows, other columns and empty
tables need no rule. Bytes that are not UTF-8 become U+FFFD. Text is handled whole; memory grows with the longest one.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightledger.llm.registry import query
from nightledger.llm.tables import documents
from nightledger.llm.words import flat

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LEAF = 48
REMEMBERED = 200_000


def load(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as lines:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError(f"{path}: ranks are not 0 to {len(pairs) - 1}")
    return [token for _, token in pairs]


class Bpe:
    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ranks = {token: rank for rank, token in enumerate(tokens)}
        self.stable_pairs: dict[tuple[int, int], bool] = {}
        self.none = len(tokens)

    def merge(self, data: bytes) -> list[int]:
        """Merge the pair of lowest rank, the leftmost first, until no pair is a token."""
        if len(data) > 2 * LEAF:
            return self.merge_long(data)
        ranks, none = self.ranks, self.none
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [ranks.get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs:
            low = min(pairs)
            if low == none:
                break
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]

    def merge_long(self, data: bytes) -> list[int]:
        """The same with a heap of pairs over a linked list of parts."""
        n, ranks = len(data), self.ranks
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if j <= i or j >= n or end[j] != stop or end[j] <= j:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (k := before[i]) >= 0 and (r := ranks.get(data[k:stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def stable(self, x: int, y: int) -> bool:
        known = self.stable_pairs.get((x, y))
        if known is None:
            if len(self.stable_pairs) > REMEMBERED:
                self.stable_pairs.clear()
            known = self.stable_pairs[x, y] = self.merge(self.tokens[x] + self.tokens[y]) == [x, y]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours' bytes from their own encodings."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = self.merge(b"".join(self.tokens[t] for t in left[len(left) - a :] + right[:b]))
            left_stands = a == len(left) or self.stable(left[-a - 1], window[0])
            right_stands = b == len(right) or self.stable(window[-1], right[b])
            if left_stands and right_stands:
                return left[: len(left) - a] + window + right[b:]
            a, b = a * (1 if left_stands else 2), b * (1 if right_stands else 2)

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.merge(data)
        middle = len(data) // 2
        return self.join(self.tree(data[:middle]), self.tree(data[middle:]))

    def piece(self, data: bytes) -> list[int]:
        """One match of the pattern: a token if it is one as a whole, else the encoding of its bytes."""
        rank = self.ranks.get(data)
        return self.tree(data) if rank is None else [rank]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 1024:
            return b"".join([self.tokens[t] for t in ids])
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def encoder(tokens, pattern: str, digests: bool):
    """The function of one task: rows with ``text`` to rows with n_tokens and ids, or digests of ids and decoded bytes."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cut = Bpe(tokens.value), regex.compile(pattern).findall
        known: dict[str, list[int]] = {}
        for batch in batches:
            data, at = flat(batch.column("text"))
            raw, sizes, first, second = data.tobytes(), [], [], []
            for i in range(batch.num_rows):
                ids: list[int] = []
                for piece in cut(raw[at[i] : at[i + 1]].decode("utf-8", "replace")):
                    own = known.get(piece)
                    if own is None:
                        own = bpe.piece(piece.encode())
                        if len(known) < REMEMBERED and len(piece) < 64:
                            known[piece] = own
                    ids += own
                sizes.append(len(ids))
                if digests:
                    first.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                    second.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                else:
                    first.append(ids)
            kept = [c for c in batch.schema.names if c != "text"]
            columns = [batch.column(c) for c in kept] + [pa.array(sizes, pa.int64())]
            if digests:
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(first, pa.string()), pa.array(second, pa.string())],
                    names=[*kept, "n_tokens", "ids_sha256", "decoded_sha256"],
                )
            else:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(first, pa.list_(pa.int32()))], names=[*kept, "n_tokens", "ids"])

    return encode


def encoded(docs: DataFrame, id_column: str = "doc_id", text: str = "text", path: str | None = None,
            pattern: str = public_tokenizers.PATTERN, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids (or ids_sha256 and decoded_sha256) of every row; the vocabulary is broadcast once."""
    tokens = docs.sparkSession.sparkContext.broadcast(load(path or public_tokenizers.path(VOCABULARY)))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"
    return rows.mapInArrow(encoder(tokens, pattern, digests), f"doc_id long, n_tokens long, {out}")


@query("op7_byte_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir), digests=True)

"""Finding windows of symbols that also start in a document with a smaller id: what goes where.

A window is K consecutive symbols (words or bytes) of one document. Equal windows must meet in one task, and texts must
not be sent around whole for every window. So each window has an anchor, the smallest of its q-grams by a hash; equal
windows have equal anchors, and neighbouring windows mostly share theirs. A run of windows with one anchor is a segment.

1. Documents are dealt into blocks (a bucketed table, so that later joins by block move no text). Every block sends the
   hashes of its anchors, once each, to the shard of the hash.
2. A shard answers which anchors stand in more than one document, and which stand in very many blocks (hot).
3. A block sends the segments of such anchors, equal ones once with the smallest document id, to the anchor's shard. A
   hot anchor's windows go one by one to the shard of the window instead, which splits the anchor.
4. A shard (the operator's own index) answers with the smallest document id of every window, as runs.
5. Blocks mark the windows whose smallest id is below their document's, and return their documents.

Steps 1, 3 and 5 compute the same segments from the same rows. Hashes only route: a shard compares symbols.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightledger.llm.tables import pieces, written
from nightledger.llm.words import flat, mixed
from nightledger.session import brief_shuffles, scratch

#: The id of documents whose id is null: larger than any other.
NO_ID = (1 << 63) - 1

PER_BUCKET = 8 << 20
BLOCKS, SHARDS = 16, 4
#: Spark takes at most 100,000 buckets; beyond so many (0.5 TB of stored texts) buckets and blocks grow instead.
MOST_BUCKETS = 1 << 16

#: An anchor in more blocks than this is hot; below it, one shard takes what the blocks' documents send for it.
HOT = 4096

SHARD_BITS, KEY_BITS = 17, 47
FACTORS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Powers of a factor kept in a process: 32 MB for each of four factors.
KEPT_POWERS = 1 << 22
#: The lowest bits of a gram's mark are free for those of its place, which tell places apart that one window can hold.
PLACE_BITS = 5


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    head = np.array([len(a) * a.itemsize for a in arrays], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(packed: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    sizes = np.frombuffer(raw, np.int64, len(kinds))
    out, at = [], 8 * len(kinds)
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(raw, kind, int(size) // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all ranges [start, start + size), one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


_POWERS: dict[int, np.ndarray] = {}


def powers(factor: int, n: int) -> np.ndarray:
    """The first ``n`` powers of a factor modulo 2^64; runs of at most ``KEPT_POWERS`` stay in the process."""
    known = _POWERS.get(factor, np.zeros(0, np.uint64))
    if len(known) < n:
        base = np.full(max(n, 1 << 20), factor, np.uint64)
        base[0] = 1
        known = np.cumprod(base, dtype=np.uint64)
        if len(known) <= KEPT_POWERS:
            _POWERS[factor] = known
    return known[:n]


def prefix_sums(values: np.ndarray, factor: int) -> np.ndarray:
    """Sums of the first 0, 1, 2, ... values times rising powers of the factor."""
    run = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(factor, len(values)), out=run[1:])
    return run


def rolling(values: np.ndarray, length: int) -> np.ndarray:
    """A mark for each run of ``length`` (scattered) symbols, by differences of prefix sums; runs may cross texts.

    The lowest ``PLACE_BITS`` bits of the 64 are left free.
    """
    n = len(values)
    if n < length:
        return np.zeros(0, np.uint64)
    run = prefix_sums(values, FACTORS[0])
    marks = run[length:] - run[:-length]
    marks *= powers(pow(FACTORS[0], -1, 1 << 64), n - length + 1)
    marks >>= np.uint64(PLACE_BITS)
    marks <<= np.uint64(PLACE_BITS)
    return marks


def range_marks(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, factors=FACTORS) -> list[np.ndarray]:
    """64-bit marks of each range of (scattered) values, by polynomials over prefix sums, one for each factor."""
    out = []
    for factor in factors:
        run, back = prefix_sums(values, factor), powers(pow(factor, -1, 1 << 64), len(values) + 1)
        out.append(mixed((run[starts + sizes] - run[starts]) * back[starts] + sizes.astype(np.uint64)))
    return out


def first_of(marks: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One index for each different range, and for every range the number of its like."""
    order = np.argsort(marks[0])
    new = np.ones(len(order), bool)
    for x in (marks[0], marks[1], sizes):
        y = x[order]
        new[1:] &= y[1:] == y[:-1]
    new[1:] = ~new[1:]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


@dataclass
class Symbols:
    """A block's documents as one run of symbols; document i has symbols at[i] to at[i + 1]."""

    values: np.ndarray  # uint64, one for each symbol
    at: np.ndarray
    raw: np.ndarray  # bytes; symbol i is raw[begin[i] : begin[i + 1]] with its separator, if any
    begin: np.ndarray
    gap: int  # bytes of the separator after a symbol


@dataclass(frozen=True)
class Shape:
    """Window length, q-gram length of the anchors, and how to read symbols."""

    window: int
    gram: int
    read: Callable[[pa.Array], Symbols]


class Segments:
    """The runs of windows with one anchor, of one block's documents."""

    def __init__(self, shape: Shape, symbols: Symbols, grams: np.ndarray):
        k, w = shape.window, shape.window - shape.gram + 1
        if w >= 1 << PLACE_BITS:
            raise ValueError("a window holds at most 31 grams")
        at, low = symbols.at, np.uint64((1 << PLACE_BITS) - 1)
        whole = np.flatnonzero(np.diff(at) >= k)
        self.start = self.doc = self.windows = np.zeros(0, np.int64)
        self.key = self.mark = np.zeros(0, np.uint64)
        if not len(whole):
            return
        # The smallest gram of 1, 2, 4, ... and at last w places; of equal ones any, as they are one anchor.
        best, wide = (grams & ~low) | (np.arange(len(grams), dtype=np.uint64) & low), 1
        while wide < w:
            step = min(wide, w - wide)
            best = np.minimum(best[step:], best[:-step])
            wide += step
        # A segment starts at a document's first window and where the anchor changes, never behind its last window.
        new = np.empty(len(best), bool)
        new[0] = True
        np.not_equal(best[1:], best[:-1], out=new[1:])
        new[at[whole]] = True
        ends = np.maximum(at[1:] - k + 1, at[:-1])
        behind = spread(ends[:-1], at[1:-1] - ends[:-1])
        new[behind[behind < len(new)]] = False
        first = np.flatnonzero(new[: ends[-1]])
        self.start, self.doc = first, np.searchsorted(at, first, "right") - 1
        self.windows = np.minimum(np.append(first[1:], ends[-1]), ends[self.doc]) - first
        self.key = grams[first + ((best[first] - first.astype(np.uint64)) & low).astype(np.int64)]
        self.mark = mixed(self.key)

    def shard(self, shards: int) -> np.ndarray:
        low = self.mark & np.uint64((1 << SHARD_BITS) - 1)
        return ((low * np.uint64(shards)) >> np.uint64(SHARD_BITS)).astype(np.int64)

    def sent(self, shards: int) -> np.ndarray:
        """The shard and, below it, the rest of the anchor's mark."""
        return (self.shard(shards).astype(np.uint64) << np.uint64(KEY_BITS)) | (self.mark >> np.uint64(SHARD_BITS))


def blocked(docs: DataFrame, id_column: str, text: str, n: int) -> DataFrame:
    """block, row, doc, text in a table that is bucketed by block, in ``n`` buckets."""
    rows = docs.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("doc"),
        F.col(id_column).isNull().alias("unnamed"),
        F.monotonically_increasing_id().alias("row"),
        F.col(text).cast("string").alias("text"),
    ).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n * BLOCKS)).cast("int"))
    name = f"blocks_{uuid.uuid4().hex}"
    path = scratch(docs.sparkSession, name)
    writer = rows.repartition(n, "block").write.option("compression", "zstd").bucketBy(n, "block")
    with brief_shuffles(docs.sparkSession):
        writer.option("path", path).saveAsTable(name)
    table = docs.sparkSession.table(name)
    table.named, table.stored_at = name, path
    return table


def bucket_count(docs: DataFrame, text: str) -> int:
    return min(pieces(docs, text, PER_BUCKET), MOST_BUCKETS)


def by_shard(shards: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The runs of equal numbers in a sorted array."""
    cuts = np.flatnonzero(np.diff(shards)) + 1
    bounds = [0, *cuts.tolist(), len(shards)]
    for a, b in zip(bounds, bounds[1:], strict=False):
        if a < b:
            yield int(shards[a]), slice(a, b)


def message(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    """Rows (shard, block, kind, data)."""
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["shard", "block", "kind", "data"])


MESSAGE = "shard int, block int, kind int, data binary"
ANCHORS, ANSWERS = 0, 1


def announce(shape: Shape, shards: int):
    """Step 1: a block's anchors; the lowest bit says that two of its documents have it."""

    def run(block: pa.Table) -> pa.Table:
        symbols = shape.read(block["text"])
        found = Segments(shape, symbols, rolling(symbols.values, shape.gram))
        key = found.sent(shards)
        order = np.argsort(key)
        key, doc = key[order], found.doc[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(first) else np.zeros(0, bool)
        sent = ((key[first] & np.uint64((1 << KEY_BITS) - 1)) << np.uint64(1)) | several.astype(np.uint64)
        shard = (key[first] >> np.uint64(KEY_BITS)).astype(np.int64)
        number = int(block["block"][0].as_py())
        return message([(s, number, ANCHORS, six(sent[at])) for s, at in by_shard(shard)])

    return run


def six(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def eight(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def shared(hot: int):
    """Step 2: to every block its anchors that another document has; the lowest bit says that they are hot."""

    def run(shard: pa.Table) -> pa.Table:
        sent = [eight(x) for x in shard["data"].to_pylist()]
        every = np.concatenate(sent)
        marks, number, count = np.unique(every >> np.uint64(1), return_inverse=True, return_counts=True)
        twice = count > 1
        twice[number[(every & np.uint64(1)) == 1]] = True
        rows, at = [], 0
        for block, own in zip(shard["block"].to_pylist(), sent, strict=True):
            mine = number[at : at + len(own)]
            at += len(own)
            mine = mine[twice[mine]]
            if len(mine):
                rows.append((shard["shard"][0].as_py(), block, ANCHORS, six((marks[mine] << np.uint64(1)) | (count[mine] > hot).astype(np.uint64))))
        return message(rows)

    return run


class Outgoing:
    """What a block sends in step 3, and how its windows find the answers in step 5."""

    def __init__(self, shape: Shape, symbols: Symbols, shards: int, docs: np.ndarray, replies: pa.Table):
        found = Segments(shape, symbols, rolling(symbols.values, shape.gram))
        known = []
        for shard, kind, data in zip(*(replies[c].to_pylist() for c in ("shard", "kind", "data")), strict=True):
            if kind == ANCHORS:
                values = eight(data)
                known.append((np.uint64(shard << KEY_BITS) | (values >> np.uint64(1)), values & np.uint64(1)))
        keys = np.concatenate([k for k, _ in known]) if known else np.zeros(0, np.uint64)
        hot = np.concatenate([h for _, h in known]) if known else np.zeros(0, np.uint64)
        order = np.argsort(keys)
        keys, hot = keys[order], hot[order]
        own = found.sent(shards)
        at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
        stays = keys[at] == own if len(keys) else np.zeros(len(own), bool)
        burning = hot[at] == 1 if len(keys) else stays
        warm, hotter = np.flatnonzero(stays & ~burning), np.flatnonzero(stays & burning)
        single = spread(found.start[hotter], found.windows[hotter])
        self.start = np.concatenate([found.start[warm], single])
        self.windows = np.concatenate([found.windows[warm], np.ones(len(single), np.int64)])
        self.doc = np.concatenate([found.doc[warm], np.repeat(found.doc[hotter], found.windows[hotter])])
        sizes = self.windows + shape.window - 1
        marks = range_marks(symbols.values, self.start, sizes)
        one = (marks[0][len(warm) :] >> np.uint64(1)) % np.uint64(shards)
        shard = np.concatenate([found.shard(shards)[warm], one.astype(np.int64)])
        first, self.number = first_of(marks, sizes)
        # Equal segments of one shard are sent once, in the order of the shard.
        order = np.argsort(shard[first], kind="stable")
        place = np.empty(len(first), np.int64)
        place[order] = np.arange(len(first))
        self.number = place[self.number] if len(first) else self.number
        self.first = first[order]
        self.shard, self.sizes = shard[self.first], sizes[self.first]
        self.low = np.full(len(first), NO_ID, np.int64)
        np.minimum.at(self.low, self.number, docs[self.doc])

    def messages(self, block: int, symbols: Symbols) -> pa.Table:
        rows = []
        for shard, at in by_shard(self.shard):
            begin = symbols.begin[self.start[self.first[at]]]
            size = symbols.begin[self.start[self.first[at]] + self.sizes[at]] - begin
            rows.append((shard, block, ANSWERS, pack(self.sizes[at].astype(np.uint32), self.low[at], symbols.raw[spread(begin, size)])))
        return message(rows)

    def removed(self, shape: Shape, symbols: Symbols, docs: np.ndarray, replies: pa.Table) -> np.ndarray:
        """For every symbol, whether a window covers it that starts in a document with a smaller id."""
        answers = {}
        for shard, kind, data in zip(*(replies[c].to_pylist() for c in ("shard", "kind", "data")), strict=True):
            if kind == ANSWERS:
                low, run = unpack(data, np.int64, np.uint32)
                answers[shard] = np.repeat(low, run)
        lows = [answers[s] for s, _ in by_shard(self.shard)]
        low = np.concatenate(lows) if lows else np.zeros(0, np.int64)
        sent = self.sizes - shape.window + 1
        offset = np.cumsum(sent) - sent
        starts = spread(self.start, self.windows)
        least = low[spread(offset[self.number], self.windows)] if len(starts) else starts
        hit = starts[least < docs[np.repeat(self.doc, self.windows)]] if len(starts) else starts
        cover = np.zeros(len(symbols.values) + shape.window + 1, np.int32)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + shape.window, -1)
        return np.cumsum(cover)[: len(symbols.values)] > 0


def answered(shape: Shape, index):
    """Step 4: ``index(bytes, sizes, lows)`` gives the smallest id of every window of the different segments of a shard."""

    def run(shard: pa.Table) -> pa.Table:
        got = [unpack(x, np.uint32, np.int64, np.uint8) for x in shard["data"].to_pylist()]
        sizes = np.concatenate([g[0] for g in got]).astype(np.int64)
        lows, raw = np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got])
        number, low = index(raw, sizes, lows)
        # ``number``: which of the different segments each one is; ``low``: their windows' smallest ids, concatenated.
        kinds = np.zeros(int(number.max()) + 1, np.int64)
        kinds[number] = sizes - shape.window + 1
        offset = np.cumsum(kinds) - kinds
        rows, at = [], 0
        for block, (own, _, _) in zip(shard["block"].to_pylist(), got, strict=True):
            mine = number[at : at + len(own)]
            at += len(own)
            least = low[spread(offset[mine], kinds[mine])]
            cut = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
            runs = np.diff(np.concatenate([cut, [len(least)]])).astype(np.uint32)
            rows.append((shard["shard"][0].as_py(), block, ANSWERS, pack(least[cut], runs)))
        return message(rows)

    return run


def dedup(docs: DataFrame, id_column: str, text: str, shape: Shape, index, finish, schema: str, hot: int = HOT) -> DataFrame:
    """``finish(block, symbols, removed)`` of every block, as a table of the schema."""
    buckets = bucket_count(docs, text)
    blocks, shards = blocked(docs, id_column, text, buckets), min(buckets * SHARDS, 1 << SHARD_BITS)
    announced = blocks.groupBy("block").applyInArrow(announce(shape, shards), MESSAGE)
    common = written(announced.groupBy("shard").applyInArrow(shared(hot), MESSAGE), "anchors")

    def outgoing(block: pa.Table, replies: pa.Table) -> tuple[Symbols, np.ndarray, Outgoing]:
        symbols, own = shape.read(block["text"]), block["doc"].to_numpy()
        return symbols, own, Outgoing(shape, symbols, shards, own, replies)

    def send(block: pa.Table, replies: pa.Table) -> pa.Table:
        if not block.num_rows or not replies.num_rows:
            return message([])
        symbols, _, out = outgoing(block, replies)
        return out.messages(block["block"][0].as_py(), symbols)

    def end(block: pa.Table, replies: pa.Table) -> pa.Table:
        symbols, own, out = outgoing(block, replies)
        return finish(block, symbols, out.removed(shape, symbols, own, replies))

    sent = blocks.groupBy("block").cogroup(common.groupBy("block")).applyInArrow(send, MESSAGE)
    answers = written(sent.groupBy("shard").applyInArrow(answered(shape, index), MESSAGE), "answers")
    return blocks.groupBy("block").cogroup(common.unionByName(answers).groupBy("block")).applyInArrow(end, schema)


def refined(keys: np.ndarray, length: int, depth: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bucket pointers of all positions by their first ``depth`` symbols, and the positions in that order.

    ``keys`` sorts positions by their first ``length`` symbols.

    A bucket's pointer is the place of its first member in the sorted order. Members of buckets of more than one are
    sorted by the pointers of their positions ``length`` further on, and the new pointers serve the next step, which
    therefore reaches twice as far; buckets of one are left alone.

    ``wanted`` (a mask) says whose pointers are asked for. A pass then sorts only members whose pointers a later pass or
    the caller reads; the other pointers, and the order of positions, stay as the first sort left them.
    """
    steps, reached = [], length
    while reached < depth:
        steps.append(min(reached, depth - reached))
        reached += steps[-1]
    read, masks = wanted, []
    for step in reversed(steps):
        masks.insert(0, read)
        if read is not None:
            later = np.zeros(len(keys), bool)
            later[step:] = read[: max(0, len(keys) - step)]
            read = read | later
    n = len(keys)
    order = np.argsort(keys)
    new = np.ones(n, bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    pointer = np.empty(n, np.int64)
    pointer[order] = np.flatnonzero(new)[np.cumsum(new) - 1] if n else 0
    for step, mask in zip(steps, masks, strict=True):
        members = order if mask is None else np.flatnonzero(mask)
        own = pointer[members]
        slots = np.flatnonzero(np.bincount(own, minlength=n)[own] > 1)
        if not len(slots):
            break
        crowded = members[slots]
        later = np.where(crowded + step < n, pointer[np.minimum(crowded + step, n - 1)] + 1, 0)
        own = pointer[crowded]
        by = np.argsort(own * np.int64(n + 1) + later)
        own, later, crowded = own[by], later[by], crowded[by]
        start = np.ones(len(by), bool)
        start[1:] = own[1:] != own[:-1]
        fresh = start.copy()
        fresh[1:] |= later[1:] != later[:-1]
        where = np.arange(len(by))
        base = np.maximum.accumulate(np.where(start, where, 0))
        top = np.maximum.accumulate(np.where(fresh, where, 0))
        pointer[crowded] = own + top - base
        if mask is None:
            order[slots] = crowded
    return pointer, order

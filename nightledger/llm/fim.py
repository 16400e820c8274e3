"""Fill-in-middle transformation by displacement scatter.

A text is cut into prefix, middle and suffix, and the parts are written in another order behind markers, so that a model
learns to fill a gap from both sides. The bytes of a whole batch move at once: a difference array holds, at the first
byte of every part, by how much its place in the output differs from that of the part before; its running sum is the
displacement of every byte, and one numpy scatter writes the output. Markers fill the places that no byte takes.
Restoring reads only the output and the form: the markers found in it give the parts, the same sums give every byte's
place, and a gather (the inverse of the scatter) brings the text back.

Cuts lie between units, which are runs of letters A-Z and a-z or single other code points; the units are found by one
scan of the bytes. Where the cuts fall, and which form is taken, follows from the SHA-256 of a seed and the id, so
reruns agree. A text that is empty or holds a marker stays plain; no other text gets a marker by being moved, since a
marker begins and ends with bytes that do not overlap another's.

Rows are judged one by one: nothing is shuffled, and repeated rows get equal answers. A batch is cut into runs of about
2 MB of text; a longer text is a run of its own, and its bytes are moved in blocks of ``BLOCK``, so a task holds a text,
its output, the places of its units, a count per byte and a few arrays of one block: about 20 times the longest text. Nulls: a null text is empty; a null id counts as an empty id text. Empty tables
give empty results; other columns are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightledger.llm.registry import query
from nightledger.llm.tables import documents
from nightledger.llm.words import flat, slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = len(PREFIX)
PLAIN, PSM, SPM = 0, 1, 2
FORMS = np.array(["plain", "psm", "spm"])

#: Percent of texts that stay plain come from here on; of the others, so many percent are written suffix first.
KEPT_FROM, SUFFIX_FIRST = 90, 20

BLOCK = 4 << 20

LETTER = np.zeros(256, bool)
LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


def units(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where every unit begins, and ``first[i]``, the first unit of text i."""
    letter = LETTER[data]
    begins = (data & 0xC0) != 0x80
    begins[1:] &= ~(letter[1:] & letter[:-1])
    heads = at[:-1][np.diff(at) > 0]
    begins[heads] = True
    start = np.flatnonzero(begins)
    return start, np.searchsorted(start, at)


def marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the markers ``<P>``, ``<S>`` and ``<M>`` begin, and the letter of each."""
    at = np.flatnonzero(data[:-2] == ord("<")) if len(data) >= MARK else np.zeros(0, np.int64)
    at = at[(data[at + 2] == ord(">")) & np.isin(data[at + 1], np.frombuffer(b"PSM", np.uint8))]
    return at, data[at + 1]


def marked(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each text holds a marker."""
    found, _ = marks(data)
    text = np.searchsorted(at, found, "right") - 1
    out = np.zeros(len(at) - 1, bool)
    out[text[found + MARK <= at[text + 1]]] = True
    return out


def displaced(parts: np.ndarray, shift: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """The displacement of every byte of [0, size), block by block, as (first byte, displacements).

    ``parts`` are the first bytes of the parts in order, ``shift`` their displacements. Each block sums its piece of the
    difference array and carries the sum on.
    """
    change = np.diff(shift, prepend=0)
    carry = 0
    for low in range(0, size, BLOCK):
        high = min(low + BLOCK, size)
        step = np.zeros(high - low, np.int64)
        a, b = np.searchsorted(parts, [low, high])
        np.add.at(step, parts[a:b] - low, change[a:b])  # an empty part shares its first byte with the next one
        step[0] += carry
        run = np.cumsum(step, out=step)
        carry = int(run[-1])
        yield low, run


def laid(at: np.ndarray, p: np.ndarray, m: np.ndarray, s: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where each text begins in the output, and by how much its prefix, middle and suffix of p, m and s bytes move."""
    out = at + MARK * 3 * np.concatenate([[0], np.cumsum(form != PLAIN)])
    base = out[:-1] - at[:-1]
    psm, spm = form == PSM, form == SPM
    prefix = base + np.select([psm, spm], [MARK, MARK + s + MARK], 0)
    middle = base + np.select([psm, spm], [MARK + MARK + s + MARK, MARK + s + MARK + MARK], 0)
    suffix = base + np.select([psm, spm], [MARK + MARK - m, MARK - p - m], 0)
    return out, prefix, middle, suffix


def transformed(data: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The outputs of all texts, joined, and where each begins; ``low`` and ``high`` are the bytes the cuts are before."""
    p, m, s = low - at[:-1], high - low, at[1:] - high
    begin, *shifts = laid(at, p, m, s, form)
    out = np.empty(begin[-1], np.uint8)
    moved = form != PLAIN
    suffix_first = form[moved] == SPM
    head, p, s = begin[:-1][moved], p[moved], s[moved]
    second = head + MARK + np.where(suffix_first, s, p)
    third = second + MARK + np.where(suffix_first, p, s)
    for j in range(MARK):
        out[head + j] = np.where(suffix_first, SUFFIX[j], PREFIX[j])
        out[second + j] = np.where(suffix_first, PREFIX[j], SUFFIX[j])
        out[third + j] = MIDDLE[j]
    parts = np.stack([at[:-1], low, high], axis=1).ravel()
    for first, shift in displaced(parts, np.stack(shifts, axis=1).ravel(), len(data)):
        here = np.arange(first, first + len(shift))
        out[here + shift] = data[first : first + len(shift)]
    return out, begin


def restored(out: np.ndarray, begin: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts, joined, and where each begins, from outputs and forms alone."""
    found, _ = marks(out)
    text = np.searchsorted(begin, found, "right") - 1
    found = found[(form[text] != PLAIN) & (found + MARK <= begin[text + 1])].reshape(-1, 3)
    moved = form != PLAIN
    if len(found) != moved.sum() or (found[:, 0] != begin[:-1][moved]).any():
        raise ValueError("an output does not hold its three markers")
    first, second = np.zeros(len(form), np.int64), np.zeros(len(form), np.int64)
    first[moved] = found[:, 1] - found[:, 0] - MARK
    second[moved] = found[:, 2] - found[:, 1] - MARK
    length = np.diff(begin) - MARK * 3 * moved
    p, s = np.where(form == SPM, second, first), np.where(form == SPM, first, second)
    at = np.concatenate([[0], np.cumsum(length)])
    m = length - p - s
    _, *shifts = laid(at, p, m, s, form)
    parts = np.stack([at[:-1], at[:-1] + p, at[:-1] + p + m], axis=1).ravel()
    back = np.empty(at[-1], np.uint8)
    for low, shift in displaced(parts, np.stack(shifts, axis=1).ravel(), len(back)):
        here = np.arange(low, low + len(shift))
        back[low : low + len(shift)] = out[here + shift]
    return back, at


def chosen(hashes: list[np.ndarray], n: np.ndarray, never: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units before the first and before the second cut, and the form, from four hashes of every text."""
    a, b = hashes[0] % (n + 1), hashes[1] % (n + 1)
    form = np.where(hashes[3] % 100 < SUFFIX_FIRST, SPM, PSM)
    form[never | (hashes[2] % 100 >= KEPT_FROM)] = PLAIN
    return np.minimum(a, b), np.maximum(a, b), form


def columns(data: np.ndarray, at: np.ndarray, hashes: list[np.ndarray]) -> dict[str, pa.Array]:
    """n, form, prefix and middle in bytes and code points, the outputs and the texts brought back from them."""
    start, first = units(data, at)
    n = np.diff(first)
    low, high, form = chosen(hashes, n, (np.diff(at) == 0) | marked(data, at))
    start = np.append(start, len(data))

    def before(cut: np.ndarray) -> np.ndarray:
        return np.where(cut < n, start[np.minimum(first[:-1] + cut, len(start) - 1)], at[1:])

    low, high = before(low), before(high)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    out, begin = transformed(data, at, low, high, form)
    back, back_at = restored(out, begin, form)
    plain = form == PLAIN
    return {
        "n": pa.array(n, pa.int64()),
        "form": pa.array(FORMS[form]),
        "prefix_chars": pa.array(points[low] - points[at[:-1]], pa.int64(), mask=plain),
        "middle_chars": pa.array(points[high] - points[low], pa.int64(), mask=plain),
        "output": binary(out, begin),
        "restored": binary(back, back_at),
    }


def binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)]
    )


def hashed(docs: DataFrame, id_column: str, text: str, seed: str) -> DataFrame:
    """Id, text and the four hashes that decide cuts and form."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    parts = [F.conv(F.substring(digest, 8 * j + 1, 8), 16, 10).cast("long").alias(f"h{j + 1}") for j in range(4)]
    return docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"), *parts)


def fill_in_middle(docs: DataFrame, id_column: str = "doc_id", text: str = "text", seed: str = "1", digests: bool = False) -> DataFrame:
    """id, n, form, prefix_chars, middle_chars and the output text of every row; with ``digests``, SHA-256 of the output
    and of the text brought back from it instead of the output."""
    kind = docs.schema[id_column].dataType.simpleString()
    shown = "output_sha256 string, restored_sha256 string" if digests else "output string"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                data, at = flat(batch.column("text"))
                hashes = [batch.column(f"h{j}").to_numpy(zero_copy_only=False) for j in (1, 2, 3, 4)]
                made = columns(data, at, hashes)
                output, back = made.pop("output"), made.pop("restored")
                if digests:
                    made["output_sha256"], made["restored_sha256"] = sha256(output), sha256(back)
                else:
                    made["output"] = output.cast(pa.large_string())
                yield pa.RecordBatch.from_arrays([batch.column("id"), *made.values()], names=["id", *made])

    schema = f"id {kind}, n long, form string, prefix_chars long, middle_chars long, {shown}"
    return hashed(docs, id_column, text, seed).mapInArrow(each, schema)


def sha256(values: pa.Array) -> pa.Array:
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[: len(values) + 1]
    view = memoryview(data)
    return pa.array([hashlib.sha256(view[at[i] : at[i + 1]]).hexdigest() for i in range(len(values))], pa.string())


@query(
    "op13_fill_in_middle",
    """
    WITH t AS (
      SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
             sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
      FROM documents
    ), c AS (
      SELECT doc_id, t, u, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a,
             ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                       OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
                  WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
      FROM t
    ), p AS (
      SELECT doc_id, t, n, form, array_to_string(u[1:least(a, b)], '') AS pre,
             array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS mid,
             array_to_string(u[greatest(a, b) + 1:], '') AS suf
      FROM c
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                  ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM p
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle(documents(spark, sf_dir), digests=True).withColumnRenamed("id", "doc_id")

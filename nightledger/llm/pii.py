"""Personal data, also in disguise: base patterns, and a normalised text whose spans are mapped back to the source.

Base patterns (email, ip, card, phone) are searched in the text as it is. For the disguised ones two transducers run one
after the other, each of which keeps, for every character it writes, where in its input that came from: the first
writes look-alike characters as ASCII and drops invisible ones, the second writes "at" and "dot" disguises and spelled
digits as the characters they stand for. The same patterns are searched in the result; a span is added when it took
in something rewritten and overlaps no base span of its kind.

All searches are linear in the text. Nulls: a null text is empty. Rows are handled one by one, so repeated rows, other
columns and empty tables need no rule. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightledger.llm.registry import query
from nightledger.llm.tables import documents
from nightledger.llm.words import flat

KINDS = ("email", "ip", "card", "phone")

LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        # The longest run of local characters before the sign, reached in steps that double.
        reach, start = 64, at
        while True:
            low = max(done, at - reach)
            run = LOCAL_RUN.match(text[low:at][::-1])
            start = at - run.end() if run else at
            if start > low or low == done:
                break
            reach *= 2
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for run in DOTTED.finditer(text):
        parts, at = run.group().split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= len(DIGIT.findall(m.group())) <= 15:
            yield m.span()


def identifiers(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the base patterns by kind."""
    digits = DIGIT.search(text) is not None
    return {
        "email": list(emails(text)) if "@" in text else [],
        "ip": list(ips(text)) if digits else [],
        "card": list(cards(text)) if digits else [],
        "phone": list(phones(text)) if digits and "+" in text else [],
    }


# Cyrillic and Greek letters, dashes and invisible characters with the ASCII text that they stand for.
# Full-width, mathematical and similar forms follow from Unicode's compatibility mapping, digits from their value.
LOOK_ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "ο": "o", "ν": "v", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".",
    "­": "", "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "",
}


def look_alikes() -> dict[str, str]:
    """Every character that the first transducer rewrites."""
    out = dict(LOOK_ALIKE)
    for code in [*range(0xA0, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)]:
        c = chr(code)
        digit = unicodedata.digit(c, None) if unicodedata.category(c) == "Nd" else None
        plain = str(digit) if digit is not None else unicodedata.normalize("NFKC", c)
        if len(plain) == 1 and " " <= plain <= "~" and c not in out and c not in "ªº¹²³":
            out[c] = plain
    return out


GLYPHS = look_alikes()

#: Where characters of GLYPHS may be; others are left as they are.
GLYPH = re.compile("[\xa0\xad\u0100-\U0010ffff]")

# The spelled digits.
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4",
    "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}
NUMERAL = "(?:" + "|".join(SPELLED) + ")"
GAP = r"[ \t]{0,2}"
BRACKET_AT = rf"{GAP}[\[({{<]{GAP}(?:at|@){GAP}[\])}}>]{GAP}"
BRACKET_DOT = rf"{GAP}[\[({{<]{GAP}(?:dot|\.){GAP}[\])}}>]{GAP}"
WORD_AT, WORD_DOT = r"[ \t]{1,2}at[ \t]{1,2}", r"[ \t]{1,2}dot[ \t]{1,2}"
DISGUISE = re.compile(
    rf"(?P<at>(?<=[A-Za-z0-9])(?:{BRACKET_AT}(?=[A-Za-z0-9])|{WORD_AT}(?=[A-Za-z0-9-]{{1,63}}(?:{BRACKET_DOT}|{WORD_DOT})[A-Za-z0-9])))"
    rf"|(?P<dot>(?<=[A-Za-z0-9])(?:{BRACKET_DOT}|{WORD_DOT})(?=[A-Za-z0-9]))"
    rf"|(?P<number>\b(?:plus[ \t]{{1,2}}(?={NUMERAL}\b|[0-9]))?{NUMERAL}(?:(?:[ \t]{{1,2}}|-|,[ \t]?)(?:{NUMERAL}|[0-9])\b)*)",
    re.IGNORECASE,
)
NUMBER_PART = re.compile(rf"plus|{NUMERAL}|[0-9]", re.IGNORECASE)
#: What a disguise cannot do without, searched in lower case: cheap tests that most texts fail.
BRACKETED = re.compile(rf"[\[({{<]{GAP}(?:at|@|dot|\.){GAP}[\])}}>]")
ONES = re.compile(r"one(?:[ \t]{1,2}|-|,[ \t]?)(?:one|[0-9])")
NEXT = re.compile(rf"{NUMERAL}(?:[ \t]{{1,2}}|-|,[ \t]?)(?:{NUMERAL}|[0-9])")
PLUS = re.compile(rf"plus[ \t]{{1,2}}{NUMERAL}")
#: Letters that the patterns take for i and s, and lower case does not.
FOLDED = re.compile("[İıſ]")
OTHERS = tuple(SPELLED)[:1] + tuple(SPELLED)[2:]


def hinted(text: str) -> bool:
    """Whether the second transducer may find something to rewrite."""
    low = text.lower()
    return (
        any(dot in low for dot in (" dot ", "\tdot", "dot\t"))
        or (any(word in low for word in OTHERS) and NEXT.search(low) is not None)
        or ("one" in low and ONES.search(low) is not None)
        or ("plus" in low and PLUS.search(low) is not None)
        or (not text.isascii() and FOLDED.search(text) is not None)
        or any(c in low and BRACKETED.search(low) is not None for c in "[({<")
    )


class Traced:
    """A text with the source range of each of its characters, and which of them were rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.begin, self.end = list(range(len(text))), list(range(1, len(text) + 1))
        self.new = bytearray(len(text))

    def rewritten(self, pattern: re.Pattern, write) -> Traced:
        """The text with ``write(match)`` for every match; what is written stands for the whole match."""
        text, begin, end, new, last = [], [], [], bytearray(), 0
        for m in pattern.finditer(self.text):
            plain = write(m)
            if plain is None:
                continue
            i, j = m.span()
            if not plain and i:  # what is left out marks the character before it
                self.new[i - 1] = 1
            text += [self.text[last:i], plain]
            begin += self.begin[last:i] + [self.begin[i]] * len(plain)
            end += self.end[last:i] + [self.end[j - 1]] * len(plain)
            new += self.new[last:i] + b"\x01" * len(plain)
            last = j
        out = Traced("")
        out.text = "".join([*text, self.text[last:]])
        out.begin, out.end, out.new = begin + self.begin[last:], end + self.end[last:], new + self.new[last:]
        return out


def undisguised(match: re.Match) -> str | None:
    if match["at"] is not None:
        return "@"
    if match["dot"] is not None:
        return "."
    parts = NUMBER_PART.findall(match["number"])
    if len(parts) < 2:
        return None
    return "".join("+" if p.lower() == "plus" else SPELLED.get(p.lower(), p) for p in parts)


def spans(text: str) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Base spans, and the base spans with the disguised ones, by kind and in order."""
    base = identifiers(text)
    glyphs = not text.isascii() and not GLYPHS.keys().isdisjoint(GLYPH.findall(text))
    if not glyphs and not hinted(text):
        return base, base
    traced = Traced(text)
    if glyphs:
        traced = traced.rewritten(GLYPH, lambda m: GLYPHS.get(m[0]))
    traced = traced.rewritten(DISGUISE, undisguised)
    every = {}
    for kind, found in identifiers(traced.text).items():
        own = base[kind]
        new = [(traced.begin[i], traced.end[j - 1]) for i, j in found if 1 in traced.new[i:j]]
        every[kind] = sorted(own + [(i, j) for i, j in new if not any(i < y and x < j for x, y in own)])
    return base, every


def listed(found: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{i}:{j}" for kind in KINDS for i, j in found[kind])


def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = flat(batch.column("text"))
        raw, columns = data.tobytes(), [[] for _ in range(6)]
        for i in range(batch.num_rows):
            base, every = spans(raw[at[i] : at[i + 1]].decode("utf-8", "replace"))
            for k, kind in enumerate(KINDS):
                columns[k].append(len(base[kind]))
            columns[4].append(hashlib.sha256(listed(base).encode()).hexdigest())
            columns[5].append(listed(every))
        kept = [c for c in batch.schema.names if c != "text"]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        names = [*kept, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in kept] + [pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names
        )


def personal_data(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base counts by kind, the digest of the base spans, and all spans as kind:start:end, comma-joined."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(search, f"doc_id long, {counts}, base_sha256 string, spans string")


@query("op8_pii")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))

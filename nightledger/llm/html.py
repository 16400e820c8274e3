"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags. Each block knows its length, the share of its characters inside links,
the share of its words that are stop words, and whether it stands inside an article or inside a part that is never
main text (menus, headers, footers, sidebars, notices, adverts, forms, reader comments). The first pass decides blocks
that are clearly one or the other; short and middling ones stay open. In the second pass an open block takes the label
of the nearest decided neighbour. Where a page marks its article, blocks outside it are decided against, blocks inside
it need no stop words, open blocks look at neighbours inside it only, and link density drops nothing but lists of links.
On a page without any block that is clearly main text the open ones are taken.

Nulls: a null page is empty and gives an empty text. Pages are handled one by one, so repeated rows, other columns and
empty tables need no rule. Unclosed and stray tags are tolerated; a page cut off inside a tag loses that tag. Raw text
(scripts, styles and the like) without an end tag runs to the end of the page. Other dropped elements without one end where
their parent does, options and selects also at the next block, buttons at the next article or other part of a page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightledger.llm.registry import query
from nightledger.llm.tables import ready
from nightledger.llm.words import flat

SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH = 0.10, 0.25
MAX_LINKS, MAX_LINKS_INSIDE = 0.33, 0.60

# Stop words of the four languages.
STOP = frozenset(
    "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which "
    "der die und das in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass "
    "le la les de des et en un une du que est pour qui dans par plus pas au sur ne se ce il sont avec son ou "
    "el los las del que y en un una por con no su para es al lo como más pero sus le ya este entre cuando todo esta".split()
)

# Tags.
DROPPED = frozenset("script style noscript template title head svg math iframe object select option textarea button canvas audio video".split())
RAW = frozenset("script style noscript iframe textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PARTS = frozenset("html body article main section nav header footer aside form dialog".split())
NEVER = frozenset("nav footer aside form menu dialog".split())
CONTAINERS = frozenset("html body div section article main nav header footer aside form menu dialog ul ol dl table tbody thead figure blockquote details".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr pre hr address figcaption summary fieldset legend caption center tfoot hgroup".split())
LISTS = frozenset("ul ol".split())
SPACED = frozenset("br td th img option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = re.compile(r"(?:^|[\s_-])(?:article|articlebody|post-content|entry-content|article-body|main-content|main)(?:$|[\s_-])", re.I)
# Words in the names of parts that are never main text, and words that may stand beside them in a name.
PART = re.compile(
    r"ads?|advert\w*|advertisement|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|gdpr|popup|modal|newsletter|subscribe|"
    r"nav\w*|menu|breadcrumbs?|footer|sidebar|widgets?|related|share|sharing|social|comments?|disqus|replies|login|search|pagination",
    re.I,
)
HEAD_PART = re.compile(r"header|masthead", re.I)
BESIDE = re.compile(
    r"|\d+|site|page|post|entry|article|blog|global|main|primary|secondary|top|bottom|left|right|inner|outer|fixed|sticky|mobile|desktop|"
    r"box|area|section|block|wrap|wrapper|container|content|list|bar|links?|buttons?|icons?|items?|posts|articles|stories|"
    r"panel|slot|unit|zone|text|message|overlay|form|group|col|column|row|thread|media|user|reader|by|js|is|has|the|and|more|also",
    re.I,
)
PIECES = re.compile(r"[-_]")
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
QUOTED = re.compile(r"=\s*+(?P<quote>[\"'])|>")
#: Every attribute, so that nothing inside the value of one is taken for another.
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])([^\s\"'>/=]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
ASKED = frozenset("class id role itemprop".split())
EDGE = re.compile(r"^\W+|\W+$")


class Block:
    """``listing`` is the number of the list that the block stands in, 0 outside lists."""

    __slots__ = ("inside", "linked", "listing", "never", "parts", "text")

    def __init__(self, inside: bool, never: bool, listing: int = 0):
        self.inside, self.never, self.listing, self.parts, self.linked, self.text = inside, never, listing, [], 0, ""


def named_part(value: str) -> str:
    """never or header, if a whole name in an attribute's value is that of such a part: site-header, but not header-image."""
    found = ""
    for name in value.split():
        pieces = PIECES.split(name)
        parts, heads = ([bool(p.fullmatch(x)) for x in pieces] for p in (PART, HEAD_PART))
        if not all(a or b or BESIDE.fullmatch(x) for a, b, x in zip(parts, heads, pieces, strict=True)):
            continue
        if any(parts):
            return "never"
        found = "header" if any(heads) else found
    return found


def kind_of(tag: str, attrs: str, inside: bool) -> str:
    """main, never, header or an empty text, by the tag and its class, id, role and itemprop."""
    if tag in ("article", "main"):
        return "main"
    if tag in NEVER:
        return "never"
    if tag == "header":
        return "never" if not inside else "header"
    if tag in ("html", "body"):
        return ""
    for name, *values in ATTRIBUTE.findall(attrs):
        value = "".join(values)
        if name.lower() not in ASKED:
            continue
        if name.lower() == "role" and value.lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog"):
            return "never"
        part = named_part(value)
        if part == "header":
            return "header" if inside else "never"
        if part:
            return part
        if MAIN.search(value):
            return "main"
    return ""


class Page:
    """A page's text, and where its tags end."""

    def __init__(self, text: str):
        self.text, self.size = text, len(text)
        self.last = {quote: text.rfind(quote) for quote in "\"'"}

    def attributes(self, at: int) -> tuple[str, int]:
        """The attributes from ``at`` on and the end of their tag; a quote that is never closed ends it at its first ``>``."""
        begin = at
        while m := QUOTED.search(self.text, at):
            if m["quote"] is None:
                return self.text[begin : m.start()], m.end()
            if m.end() > self.last[m["quote"]]:
                end = self.text.find(">", m.end())
                return (self.text[begin:end], end + 1) if end >= 0 else (self.text[begin:], self.size)
            at = self.text.find(m["quote"], m.end()) + 1
        return self.text[begin:], self.size

    def raw_end(self, tag: str, at: int) -> int:
        """The end of raw text, or of the page."""
        close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(self.text, at)
        return close.end() if close else self.size

    def dropped_end(self, tag: str, at: int, around: Counter) -> int:
        """The end of a dropped element; ``around`` counts the open tags that it stands in."""
        opened, inside = [tag], Counter([tag])
        while at < self.size:
            m = TOKEN.match(self.text, at)
            start, at = at, m.end()
            name = (m["tag"] or "").lower()
            if not name:
                continue
            attrs, at = self.attributes(at)
            if m["end"]:
                if not inside[name]:
                    if around[name]:
                        return start
                    continue
                closed = name
            elif (tag in ("option", "select") and name in BLOCKS and name != "hr") or (tag == "button" and name in PARTS):
                return start
            elif name in ("option", "button") and inside[name]:  # its start ends the one before it
                closed = name
            else:
                closed = ""
            if closed:
                while (popped := opened.pop()) != closed:
                    inside[popped] -= 1
                inside[closed] -= 1
                if not opened:
                    return at if m["end"] else start
            if m["end"] or name in VOID or attrs.endswith("/"):
                continue
            if name in RAW and not (name == "title" and (inside["svg"] or inside["math"])):
                at = self.raw_end(name, at)
                continue
            opened.append(name)
            inside[name] += 1
        return self.size


def blocks(page: str) -> list[Block]:
    """The page's blocks that have text, in page order; time is linear in the page however deep its tags nest."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    kinds, tags, lists, n_lists = Counter(), Counter(), [0], 0
    links = inside = never = header = heading = 0
    current: Block | None = None
    whole, around = Page(page), Counter()
    at, size = 0, len(page)
    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        text, tag = m["text"], (m["tag"] or "").lower()
        if text is not None:
            if current is None:
                current = Block(inside > 0, never > 0 or (header > 0 and not heading), lists[-1])
                out.append(current)
            current.parts.append(text)
            if links:
                current.linked += len(text.strip())
            continue
        if not tag:
            continue
        attrs, at = whole.attributes(at)
        if tag in DROPPED and not m["end"]:
            if attrs.endswith("/") and tag in ("svg", "math"):
                continue
            if tag in RAW:
                at = whole.raw_end(tag, at)
            elif tag != "head":
                at = whole.dropped_end(tag, at, around)
            elif close := re.compile(r"</head\b[^>]*(?:>|\Z)", re.I).search(page, at):
                at = close.end()
            continue
        if m["end"]:
            around[tag] = max(0, around[tag] - 1)
        elif tag not in VOID:
            around[tag] += 1
        if tag == "a":
            links = 0 if m["end"] else 1
        elif tag in SPACED and current is not None:
            current.parts.append(" ")
        if tag in BLOCKS:
            current = None
            links = 0 if tag in CONTAINERS else links
        if tag in HEADINGS:
            heading = 0 if m["end"] else 1
        if tag not in CONTAINERS:
            # A paragraph or cell of its own may also be marked as an advert or notice.
            if tag in BLOCKS and not m["end"] and kind_of(tag, attrs, True) == "never":
                current = Block(inside > 0, True)
                out.append(current)
            continue
        if not m["end"]:
            kind = kind_of(tag, attrs, inside > 0)
            stack.append((tag, kind))
            kinds[kind] += 1
            tags[tag] += 1
            if tag in LISTS:
                n_lists += 1
                lists.append(n_lists)
        elif tags[tag]:
            closed = ""
            while closed != tag:
                closed, kind = stack.pop()
                kinds[kind] -= 1
                tags[closed] -= 1
                if closed in LISTS:
                    lists.pop()
        inside, never, header = kinds["main"], kinds["never"], kinds["header"]
    for b in out:
        b.text = " ".join(html.unescape("".join(b.parts)).split())
    return [b for b in out if b.text]


def stop_share(text: str) -> float:
    words = text.lower().split()
    return sum(EDGE.sub("", w) in STOP for w in words) / max(1, len(words))


def link_lists(found: list[Block]) -> set[int]:
    """Lists of two or more blocks that are mostly links."""
    sizes, linked, blocks_of = Counter(), Counter(), Counter()
    for b in found:
        if b.listing:
            sizes[b.listing] += len(b.text)
            linked[b.listing] += b.linked
            blocks_of[b.listing] += 1
    return {n for n, size in sizes.items() if blocks_of[n] > 1 and linked[n] > MAX_LINKS_INSIDE * size}


def first_pass(block: Block) -> bool | None:
    """True: main text, False: not, None: open."""
    size = len(block.text)
    if block.inside:
        return None if size < SHORT else True
    if block.linked > MAX_LINKS * max(1, size):
        return False
    if size < SHORT:
        return None
    stops = stop_share(block.text)
    if stops >= STOP_HIGH:
        return True if size >= LONG else None
    return None if stops >= STOP_LOW else False


def nearest(labels: list[bool | None], default: bool, ties: bool) -> list[bool]:
    """Open labels take the nearest decided one; between two as near, ``ties``; with none decided, ``default``."""
    n = len(labels)
    left, right = [None] * n, [None] * n
    last = None
    for i in range(n):
        last = i if labels[i] is not None else last
        left[i] = last
    last = None
    for i in reversed(range(n)):
        last = i if labels[i] is not None else last
        right[i] = last
    out = []
    for i in range(n):
        a, b = left[i], right[i]
        if a is None and b is None:
            out.append(default)
        elif a is None or b is None:
            out.append(labels[b if a is None else a])
        elif labels[a] == labels[b] or i - a != b - i:
            out.append(labels[a] if i - a <= b - i else labels[b])
        else:
            out.append(ties)
    return out


def main_text(page: str) -> str:
    found = blocks(page)
    marked = any(b.inside and not b.never for b in found)
    menus = link_lists(found)
    # Parts that are never main text, and lists of links inside an article, lend their label to nobody.
    eligible = [b for b in found if not b.never and (not marked or (b.inside and b.listing not in menus))]
    labels = [first_pass(b) for b in eligible]
    if True not in labels:
        kept = [label is None for label in labels]
    else:
        kept = nearest(labels, marked, marked)
    return "\n".join(b.text for b, keep in zip(eligible, kept, strict=True) if keep)


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, at = flat(batch.column("html"))
        raw = data.tobytes()
        texts = [main_text(raw[at[i] : at[i + 1]].decode("utf-8", "replace")) for i in range(batch.num_rows)]
        kept = [c for c in batch.schema.names if c != "html"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in kept] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=[*kept, "text", "n_chars"],
        )


def extracted(pages: DataFrame, id_column: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, main text and its length in code points of every page."""
    rows = pages.select(
        F.col(id_column).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html")
    )
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")


@query("op10_html_extraction")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(ready(spark).read.parquet(f"{sf_dir}/pages.parquet"))

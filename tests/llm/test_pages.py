"""Dropped tags that are not closed, and quoted attribute values of any length and content."""

from __future__ import annotations

import random
import re
import time

from nightledger.llm.html import main_text
from nightledger.llm.pii import emails

ARTICLE = "<article><h1>Head</h1><p>First para.</p><p>Second one.</p></article>"
TEXT = "Head\nFirst para.\nSecond one."


def test_unclosed_dropped_tags_end_with_their_parent():
    for before in (
        "<datalist id=x><option value=a><option value=b></datalist>",
        "<form><select><option>One<option>Two</select></form>",
        "<form><select><option>One<option>Two</form>",
        "<form><input list=x><datalist id=x><option>a<option>b</datalist><button>Go</form>",
        "<div><button>Go</div><div><button>Menu</button></div>",
        "<header><button>Menu<svg><title>Icon</svg></header>",
        "<select><option>One",
        "<button>Menu",
        "<div><video src=x></div>",
        "<button><div>Label</div></button>",
        "<svg><g><title>Icon</title><path d='M0 0'/></g></svg>",
        "<svg><svg></svg><text>inner</text></svg>",
        "<template><div><p>Not shown</p></div></template>",
    ):
        assert main_text(f"<body>{before}{ARTICLE}</body>") == TEXT, before
    assert main_text(f"<body>{ARTICLE}<script>var x = '<p>'; </body>") == TEXT
    assert main_text("<article><p>Click <button>Go</p><p>After.</p></article>") == "Click\nAfter."


def test_quoted_values():
    for attrs in (
        'data-tip="<b>x</b>"',
        "data-tip='<b class=\"ad\">x</b>'",
        'data-tip = "<b class=\'ad\'> x > y</b>"',
        f'data-x="{"a > b " * 5000}"',
        'title="a" data-x="it\'s > that"',
    ):
        assert main_text(f"<article><p {attrs}>Hello</p><p>World</p></article>") == "Hello\nWorld", attrs[:60]
    assert main_text('<article><p>One</p><p data-x="never closed>Two</p></article>') == "One\nTwo"
    assert main_text("<article><p class = 'ad' data-x='<i>'>Buy</p><p>It's <b title=it's>text</b></p></article>") == "It's text"


def test_many_unclosed_tags_take_linear_time():
    began = time.time()
    for piece in ("<button>x", "<p a=\"x' b='", "<select><option>", "<div><video>", "<p a='"):
        main_text(piece * 20_000)
    assert time.time() - began < 60


def test_an_article_keeps_paragraphs_that_are_links_and_their_neighbours():
    link = "<a href=x>A long piece of text that is a link from its first word to its very last one</a>"
    page = f"<article><h1>Head</h1><p>First para with text.</p><p>{link}</p><p>Second one.</p></article>"
    assert main_text(page).split("\n") == ["Head", "First para with text.", link[10:-4], "Second one."]
    menu = "<ul><li><a href=a>One</a></li><li><a href=b>Two</a></li></ul>"
    assert main_text(f"<article><p>Before.</p>{menu}<p>After.</p></article>") == "Before.\nAfter."
    notes = "<ul><li>See the <a href=a>page</a> on it.</li><li>Or ask.</li></ul>"
    assert main_text(f"<article><p>Before.</p>{notes}</article>") == "Before.\nSee the page on it.\nOr ask."


def test_short_paragraphs_without_an_article():
    assert main_text("<nav>Home</nav><div id=content><p>One short line.</p><p>Another.</p></div>") == "One short line.\nAnother."
    assert main_text("<div><a href=x>Home</a></div><div id=content><p>One short line.</p></div>") == "One short line."
    assert main_text("<nav>Home</nav><footer>End</footer>") == ""


def test_part_names_are_whole_names():
    for name in ("related-work", "share-price", "notice-period", "header-image", "search-results-analysis", "adverse"):
        assert main_text(f"<article><p>One.</p><div class='{name}'><p>Two.</p></div></article>") == "One.\nTwo.", name
    for name in ("ad", "ad-banner", "cookie-notice", "related-posts", "box share-buttons", "post-comments", "comments_list", "sidebar", "ad-slot-2"):
        assert main_text(f"<article><p>One.</p><div class='{name}'><p>Two.</p></div></article>") == "One.", name
    assert main_text("<article><div class='entry-header'><h1>Head</h1><p>By someone</p></div><p>One.</p></article>") == "Head\nOne."
    assert main_text("<div class='site-header'><h1>Site</h1></div><article><p>One.</p></article>") == "One."


def test_deep_nesting_takes_linear_time():
    began = time.time()
    assert main_text("<div>" * 200_000 + "<p>Deep.</p>" + "</div>" * 200_000) == "Deep."
    assert main_text("<article>" + "<section class=a>" * 100_000 + "<p>Deep.</p>") == "Deep."
    assert time.time() - began < 60


def test_long_runs_before_a_sign_take_linear_time():
    began = time.time()
    assert list(emails("a" * 200_000 + " " + "b" * 200_000 + "@example.org")) == [(200_001, 400_013)]
    assert list(emails("a" * 200_000 + "@ " + "b" * 200_000)) == []
    assert time.time() - began < 20


def test_emails_equal_the_plain_pattern():
    plain = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice("ab1.@@-_ é") for _ in range(rng.randrange(30)))
        assert list(emails(text)) == [m.span() for m in plain.finditer(text)], text


def test_generated_pages_give_their_article_whole():
    """Articles of known paragraphs between menus, adverts, forms, comments and scripts, with or without an article tag."""
    rng = random.Random(29)
    words = "the of and to in is that for it as with was on at by stone river light paper morning house seven garden &amp; caf&eacute;".split()
    around = [
        "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>", "<header><h2>Site name</h2></header>",
        "<aside><p>Most read this week</p></aside>", "<div class='ad'><p>Buy one now</p></div>", "<script>var a = '<p>no</p>';</script>",
        "<form><input name=q><button>Search</button></form>", "<style>p { color: red }</style>", "<div class=cookie-notice>We use cookies</div>",
    ]
    for _ in range(300):
        marked, body, want = rng.random() < 0.7, [], []
        for _ in range(rng.randint(2, 8)):
            chosen = [rng.choice(words) for _ in range(rng.randint(12 if not marked else 1, 60))]
            shown = [f"<b>{w}</b>" if rng.random() < 0.1 else w for w in chosen]
            body.append("<p>" + rng.choice([" ", "\n ", "  "]).join(shown) + "</p>")
            want.append(" ".join(chosen).replace("&amp;", "&").replace("&eacute;", "\u00e9"))
        before, after = (rng.sample(around, rng.randint(0, 5)) for _ in range(2))
        main = f"<article>{''.join(body)}</article>" if marked else f"<div id=content>{''.join(body)}</div>"
        comments = "<section class=comments><p>A reader writes at length about this</p></section>" if rng.random() < 0.5 else ""
        page = f"<html><body>{''.join(before)}{main}{comments}{''.join(after)}<footer>End</footer></body></html>"
        assert main_text(page) == "\n".join(want), page

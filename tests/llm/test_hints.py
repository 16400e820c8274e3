"""The cheap test before the second transducer never skips a text that it would rewrite."""

from __future__ import annotations

import random
import re

from nightledger.llm import pii


def test_plus_before_one_numeral():
    for text, every in {
        "call plus one (555) 123-4567": "phone:5:28",
        "plus seven (495) 123-45-67": "phone:0:26",
        "PLUS\tOne 555 123 4567": "phone:0:21",
    }.items():
        base, found = pii.spans(text)
        assert (pii.listed(base), pii.listed(found)) == ("", every), text


def test_every_rewritten_text_is_hinted():
    rng = random.Random(17)
    parts = [*pii.SPELLED, "plus", "PLUS", "One", "SEVEN", "fıve", "fİve", "ſix", "plusone", "at", "dot", "Dot", "@", ".", "a", "ex", "org", "1", "55", "é"]
    gaps = [" ", " ", " ", "  ", "   ", "\t", "\n", "-", ",", ", ", "", "(", ")", "[", "]", "<", ">", "{", "}", " ( ", " ) "]
    rewritten = 0
    for _ in range(60_000):
        text = "".join(rng.choice(parts) + rng.choice(gaps) for _ in range(rng.randint(1, 6)))
        if any(pii.undisguised(m) is not None for m in pii.DISGUISE.finditer(text)):
            rewritten += 1
            assert pii.hinted(text), repr(text)
    assert rewritten > 5_000


# The four patterns as they are stated, without the short cuts of the module.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, found):
    digits = [int(c) for c in found if c in "0123456789"]
    if kind == "ip":
        return all(int(part) <= 255 for part in found.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        doubled = [sum(divmod(2 * d, 10)) for d in digits[-2::-2]]
        return 13 <= len(digits) <= 19 and (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0
    return True


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(23)
    parts = ["4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559", "1.2.3.4", "300.1.2.3", "10.0.0.255", "+49 (30) 1234-5678", "+1"]
    parts += ["a.b@c.de", "x@y", "@", "555 0100", "é", "Word", "...", "0", "00000000000000"]
    counts = dict.fromkeys(PLAIN, 0)
    for _ in range(30_000):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", "-", ".", ", ", "\n"]) for _ in range(rng.randint(0, 6)))
        base = pii.identifiers(text)
        for kind, pattern in PLAIN.items():
            want = [m.span() for m in re.finditer(pattern, text) if holds(kind, m[0])]
            assert base[kind] == want, (kind, text)
            counts[kind] += len(want)
    assert min(counts.values()) > 1000

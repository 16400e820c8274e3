"""Near copies: the shingles and similarity of the corpus stage, against a plain version."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nightledger.llm import anchors, jaccard, words_dedup
from tests.llm import brute

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def word(rng):
    return "".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 12)))


def plain(rows, shingle, percent):
    """Sorted (id, set size, smallest id reachable) of (id, text) rows."""
    sets = []
    for _, text in rows:
        words = brute.WORD.findall((text or "").translate(brute.FOLD))
        sets.append({tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set())
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]) and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        least[r] = min(d, least.get(r, d))
    return sorted((d, len(s), least[r]) for (d, _), s, r in zip(rows, sets, root, strict=True))


def changed(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = word(rng)
    return out


def table(spark, given):
    return spark.createDataFrame(given, "doc_id long, text string")


def shown(df):
    return sorted(tuple(r) for r in df.select("doc", "n_shingles", F.col("component")).collect())


def copies(rng):
    """Texts with copies of 0 to 12 changed words, so that similarities lie on both sides of the bound."""
    out = [(0, ""), (1, "one"), (2, "One  two three"), (3, "one two\tthree")]
    for _ in range(12):
        base = [word(rng) for _ in range(rng.choice([6, 40, 120, 300]))]
        for n in range(0, 13, 2):
            out.append((len(out), " ".join(changed(rng, base, min(n, len(base) // 3)))))
    return out


@pytest.mark.parametrize("hot", [1, 24])
def test_stage_shingles_and_similarity(spark, hot):
    given = copies(random.Random(11))
    got = jaccard.near_duplicates(table(spark, given), hot=hot, shingle=5, percent=80)
    assert shown(got) == plain(given, 5, 80)
    assert plain(given, 5, 80) != plain(given, 3, 90)


def test_near_stage_keeps_one_of_copies_from_eighty_percent_on(spark):
    rng = random.Random(12)
    base = [word(rng) for _ in range(500)]
    copy = list(base)
    for i in range(25, 500, 50):  # 5-word shingles: 446 of 546; 3-word shingles: 468 of 528
        copy[i] = word(rng)
    given = [(1, " ".join(base)), (2, " ".join(copy)), *((d + 3, t) for d, t in copies(rng))]
    kept = dict(corpus_pipeline.STAGES)["near"](spark, table(spark, given), "")
    assert sorted(r.doc_id for r in kept.collect()) == [d for d, n, low in plain(given, 5, 80) if d == low]
    assert 2 not in {r.doc_id for r in kept.collect()}


def respaced(rng, words):
    """The words in lines of 12 to 14, indented, and with tabs and wide gaps between some of them."""
    out, at = [], 0
    while at < len(words):
        n = rng.randint(12, 14)
        out.append(" " * 16 + "".join(w + rng.choice([" "] * 6 + ["\t", "     "]) for w in words[at : at + n]))
        at += n
    return "\n".join(out)


@pytest.mark.parametrize(("shingle", "percent"), [(3, 90), (5, 80)])
def test_copies_that_are_spaced_differently(spark, shingle, percent):
    rng = random.Random(13)
    given = []
    for i in range(50):
        base = [word(rng) for _ in range(rng.randint(100, 300))]
        given += [(2 * i, " ".join(base)), (2 * i + 1, respaced(rng, changed(rng, base, 1)))]
    got = jaccard.near_duplicates(table(spark, given), shingle=shingle, percent=percent)
    want = plain(given, shingle, percent)
    assert shown(got) == want and sum(d != low for d, _, low in want) == 50


def thue_morse(n, pair):
    return "".join(pair[bin(i).count("1") % 2] for i in range(n))


def test_long_words_of_regular_build_are_different(spark):
    """1,024 letters in the order of Thue and Morse, and the same with the letters exchanged."""
    one, two = thue_morse(1024, "ab"), thue_morse(1024, "ba")
    rows = [(1, one), (2, two), (3, f"{one} x y {two} x y"), (4, f"{one} x y {one} x y"), (5, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.near_duplicates(docs, shingle=3, percent=90).select("doc", "n_shingles", "component").collect()
    assert sorted(map(tuple, got)) == plain(rows, 3, 90)
    seven = [(i, " ".join([one if j == i % 3 else two for j in range(20)])) for i in range(6)]
    docs = spark.createDataFrame(seven, "doc_id long, text string")
    shape = anchors.Shape(13, 6, words_dedup.read)
    schema = "doc_id long, n long, n_removed long, kept_sha256 string"

    def finish(block, symbols, removed):
        out = words_dedup.result(True)(block, symbols, removed)
        return out.rename_columns(["doc_id", "n", *out.column_names[2:]])

    got = anchors.dedup(docs, "doc_id", "text", shape, words_dedup.least_ids, finish, schema).collect()
    assert sorted(map(tuple, got)) == [(a, b, c, e) for a, b, c, _, e in brute.substrings(seven, 13, True)]


def test_buckets_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(anchors, "pieces", lambda *_: 12_000_000)  # 100 TB
    assert anchors.bucket_count(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "text") <= 100_000

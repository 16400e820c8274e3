"""The text operators against plain versions, and their defined results for odd rows."""

from __future__ import annotations

import itertools
import random
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from nightledger.llm import anchors, bytes_dedup, html, jaccard, mixing, pii, quality, sharding, words_dedup
from nightledger.llm.bpe import VOCABULARY, Bpe, encoded, load
from nightledger.llm.exact import drop_copies, exact_groups
from nightledger.llm.queries import QUERIES
from nightledger.llm.tables import ascii_lower
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, block string, id string, host int"


def rows():
    """Ids and texts: passages that recur, near and exact copies, repeated rows, nulls, empty and long texts."""
    rng = random.Random(3)
    words = ["w" + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    base = [rng.choice(words) for _ in range(80)]
    out = [(0, "A Short text"), (1, ""), (2, None), (None, passage), (None, None), (3, passage + " end"), (3, "other " + passage)]
    out += [(4, "x " * 3000 + passage), (4, "x " * 3000 + passage), (5, "\t \n"), (6, "a short TEXT"), (7, "é" * 60 + "É"), (8, "é" * 60 + "É")]
    for i in range(10, 50):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(80)] = rng.choice(words)
        out.append((i, " ".join(copy)))
    for i in range(50, 70):
        out.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) + "\n" + passage))
    return out


def table(spark, given):
    filled = [(d, t, "en", None if (d or 0) % 7 == 3 else f"s{(d or 0) % 3}", 1, 2, "r", "b", "i", 9) for d, t in given]
    return spark.createDataFrame(filled, SCHEMA)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("hot", [0, 4096])
@pytest.mark.parametrize("unit", ["words", "bytes"])
def test_substrings(spark, unit, hot):
    of_words = unit == "words"
    module, length = (words_dedup, 13) if of_words else (bytes_dedup, 50)
    shape = anchors.Shape(13, 6, module.read) if of_words else anchors.Shape(50, 27, module.read)
    schema = "doc_id long, n long, n_removed long, " + ("" if of_words else "n_spans long, ") + "kept_sha256 string"

    def finish(block, symbols, removed):
        out = module.result(True)(block, symbols, removed)
        return out.rename_columns(["doc_id", "n", *out.column_names[2:]])

    got = found(anchors.dedup(table(spark, rows()), "doc_id", "text", shape, module.least_ids, finish, schema, hot=hot))
    want = brute.substrings(rows(), length, of_words)
    assert got == sorted(((a, b, c, e) if of_words else (a, b, c, d, e) for a, b, c, d, e in want), key=repr)


@pytest.mark.parametrize("hot", [1, 24])
def test_components(spark, hot):
    got = jaccard.near_duplicates(table(spark, rows()), hot=hot).select(
        F.when(~F.col("unnamed"), F.col("doc")), "n_shingles", F.when(F.col("component") != anchors.NO_ID, F.col("component"))
    )
    assert found(got) == brute.components(rows())


def test_queries_on_whole_table(spark):
    given = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    assert found(QUERIES["op1_substring_dedup"](spark, SMALL)) == [(a, b, c, e) for a, b, c, _, e in brute.substrings(given, 13, True)]
    assert found(QUERIES["op3_suffix_array_dedup"](spark, SMALL)) == brute.substrings(given, 50, False)
    assert found(QUERIES["op4_ngram_jaccard_join"](spark, SMALL)) == brute.components(given)


def test_exact_copies(spark):
    docs = table(spark, rows())
    got = {(r.id, r.keep, r.size) for r in exact_groups(docs, "doc_id", ascii_lower(F.col("text"))).collect()}
    groups = {}
    for d, t in rows():
        groups.setdefault((t or "").translate(brute.FOLD), []).append(d)
    want = {(d, max((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for d in g}
    assert got == want
    kept = drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_quality(spark):
    line = "this line stands in every document of the host and is long enough"
    given = [(i, f"{line}\n" + " ".join("own" + "abcdefghij"[i // 10] + "abcdefghij"[i % 10] * (k + 1) for k in range(40))) for i in range(30)]
    given += [(40, f"{line}\nfew own words"), (41, None), (42, "a b c d e " * 9), (43, "same\nsame\n\n" + "p q r s t u v w x y z")]
    got = {r.id: r for r in quality.line_frequency(table(spark, given), min_docs=5).collect()}
    assert all(got[i].kept for i in range(30)) and not got[40].kept and not got[40].base_failed
    assert got[41].base_failed and got[42].base_failed and got[42].n_repeat_words == 45 and got[43].n_dup_lines == 1


def test_flow():
    members = [[0], [0, 1], [1]]
    for sizes, quotas in itertools.product([(4, 6, 2), (1, 9, 0)], [(5, 5), (12, 1), (20, 20), (0, 7)]):
        taken = mixing.flow(list(sizes), members, list(quotas))

        def fits(t, quotas=quotas):
            spare = [max(0, quotas[0] - t[0]), max(0, quotas[1] - t[2])]
            return t[0] <= quotas[0] and t[2] <= quotas[1] and t[1] <= sum(spare)

        every = [t for t in itertools.product(*[range(2 * s + 1) for s in sizes]) if fits(t)]
        best = max(sum(t) for t in every)
        least = min(sum(max(0, x - s) for x, s in zip(t, sizes, strict=True)) for t in every if sum(t) == best)
        assert fits(taken) and sum(taken) == best
        assert sum(max(0, x - s) for x, s in zip(taken, sizes, strict=True)) == least


def test_mixing(spark):
    docs = table(spark, rows())
    both = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("=a"), F.lit("=b"))).otherwise(F.array(F.lit("=b")))
    taken = mixing.mixed(docs, both).collect()
    assert len(taken) == len(rows()) and all(0 <= r.copies <= 2 and r.taken == r.copies * r.size for r in taken)
    single = mixing.mixed(docs, F.array(mixing.label(F.col("source")))).collect()
    again = mixing.mixed(docs, F.array(mixing.label(F.col("source")))).collect()
    plain = lambda rs: sorted((r.id is None, r.id or 0, r.size, r.taken) for r in rs)
    assert plain(single) == plain(again)
    assert mixing.repeated(docs).count() == sum(r.copies for r in single)


def test_bpe(spark):
    bpe = Bpe(load(public_tokenizers.path(VOCABULARY)))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rng = random.Random(5)
    for size, letters in itertools.product([1, 7, 48, 49, 200, 1500], ["a", "ab", " theronig", "0123456789abcdef", "éüñ", "!#-_="]):
        data = "".join(rng.choice(letters) for _ in range(size))
        assert bpe.piece(data.encode()) == known._encode_single_piece(data.encode())
    got = encoded(table(spark, rows())).collect()
    want = [known.encode_ordinary(t or "") for _, t in rows()]
    assert sorted(r.ids for r in got) == sorted(want)
    assert all(bpe.decode(r.ids).decode() in {t or "" for _, t in rows()} for r in got)


def test_personal_data():
    cases = {
        "a.b@c.de, 1.2.3.4.5.6.7.8 300.1.1.1 +49 (30) 1234-5678, 4111 1111 1111 1111": (
            "email:0:8,ip:10:17,ip:18:25,card:56:75,phone:36:54",
            "email:0:8,ip:10:17,ip:18:25,card:56:75,phone:36:54",
        ),
        "jo (at) ex dot org": ("", "email:0:18"),
        "jo​@ex.org": ("", "email:0:10"),
        "ｊｏ@ex．org": ("", "email:0:9"),
        "call plus four nine one five one two three four five": ("", "phone:5:52"),
        "ip 1 dot 2 dot 3 dot 44": ("", "ip:3:23"),
        "nothing at all, one day": ("", ""),
        "": ("", ""),
    }
    for text, (base, every) in cases.items():
        got = pii.spans(text)
        assert (pii.listed(got[0]), pii.listed(got[1])) == (base, every), text
    assert pii.listed(pii.spans("a" * 200_000 + "@b.c" + "1" * 100_000)[0]) == "email:0:300004"


def test_main_text():
    page = (
        "<html><head><title>T</title></head><body><header>Site</header><nav><a href=x>Menu</a></nav><div class='ad'>Buy</div>"
        "<article><h1>Head &amp; line</h1><p>First  <b>para\ngraph.<p>Second<br>one.</p><div class=comments><p>Reader says</p></div>"
        "<script>var x='</p>';</script></article><footer>&copy;</footer></body>"
    )
    assert html.main_text(page) == "Head & line\nFirst para graph.\nSecond one."
    prose = "the of and to in is that for it as was with be by on not he his but at are this have from " * 3
    assert html.main_text(f"<div><a href=x>Home</a> <a href=y>News</a></div><p>{prose}</p><p>Short.</p>") == prose.strip() + "\nShort."
    assert html.main_text("") == "" and html.main_text("<p") == ""


def test_sharding(spark):
    got = sharding.sharded(table(spark, rows()), "doc_id", "text", [1.0] * 16, [1.0] * 17).collect()
    assert len(got) == len(rows())
    for shard, group in itertools.groupby(sorted(got, key=lambda r: r.shard), lambda r: r.shard):
        assert sorted(r.slot for r in group) == list(range(sum(r.shard == shard for r in got)))
    assert all(r.grown_shard in (r.shard, 16) for r in got)
    crc = sorted(zlib.crc32((t or "").encode()) for _, t in rows())
    assert sorted(r.text_crc32 for r in got) == crc
    many = spark.range(20_000).select(sharding.rendezvous(F.col("id"), [1.0, 3.0]).alias("s")).groupBy("s").count().collect()
    assert abs({r.s: r["count"] for r in many}[1] - 15_000) < 400


def test_empty_tables(spark):
    docs = table(spark, [])
    for out in (
        words_dedup.remove_repeated_words(docs), bytes_dedup.remove_repeated_bytes(docs), jaccard.near_duplicates(docs),
        exact_groups(docs, "doc_id", F.col("text")), quality.line_frequency(docs), mixing.repeated(docs), encoded(docs),
        pii.personal_data(docs), sharding.sharded(docs, "doc_id", "text", [1.0], [1.0, 1.0]),
    ):
        assert out.count() == 0


def test_pipeline(spark):
    """Each stage against a plain version on what the stage before it kept."""
    docs = table(spark, rows() + [(100 + i, " ".join(f"v{i}x{k}" for k in range(30))) for i in range(20)]).select(
        "doc_id", "text", "lang", "source", "n_chars"
    )
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: sorted((r.doc_id, r.text) for r in df.collect() if r.doc_id is not None)
    good = stages["quality"](spark, docs, SMALL).cache()
    verdict = quality.line_frequency(docs).filter("kept").select("id").distinct().count()
    assert good.select("doc_id").distinct().count() == verdict
    once = stages["exact"](spark, good, SMALL).cache()
    assert once.count() == len({(r.text or "").translate(brute.FOLD) for r in good.collect()})
    near = stages["near"](spark, once, SMALL).cache()
    own = texts(once)
    assert texts(near) == [(d, t) for d, t in own if (d, d) in {(a, c) for a, _, c in brute.components(own, 5, 80)}]
    assert len(texts(near)) < len(own)
    mixed = stages["mix"](spark, near, SMALL).cache()
    planned = mixing.mixed(near, F.array(mixing.label(F.col("source")))).collect()
    times = Counter((r.doc_id, len(brute.WORD.findall(r.text or ""))) for r in mixed.collect())
    assert times == Counter((r.id, r.size) for r in planned for _ in range(r.copies))
    assert mixed.columns == docs.columns
    bpe = Bpe(load(public_tokenizers.path(VOCABULARY)))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    got = sorted((r.doc_id, r.ids) for r in stages["tokens"](spark, mixed, SMALL).collect())
    assert got == sorted((r.doc_id, known.encode_ordinary(r.text or "")) for r in mixed.collect())


def test_stages_leave_other_columns_alone(spark):
    """Names that the stages use themselves stay the columns of the table, and ids of another integer type are taken."""
    names = ["__id", "__own", "__n", "__rank", "__k", "__frequent", "__shorter", "__mark", "number", "doc", "row"]
    docs = table(spark, [r for r in rows() if r[0] is not None]).select(
        F.col("doc_id").cast("int").alias("doc_id"), "text", "lang", "source", "n_chars", *(F.lit(n).alias(n) for n in names)
    )
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        assert out.count() > 0 and out.select(*names).distinct().collect() == [tuple(names)], name

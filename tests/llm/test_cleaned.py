"""Kept documents lose the lines that are frequent on their host."""

from __future__ import annotations

import corpus_pipeline

LINE = "Subscribe now to all 10 of our letters"


def own(i):
    return " ".join(f"{'abcdefghij'[i]}{'qrstuvwxyz'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(40))


def test_stage_takes_frequent_lines_out(spark):
    given = [(i, f"{own(i)}\n\n  {LINE.upper()}\t\nlast é {own(i)[::-1]}", "h", 7) for i in range(8)]
    given += [(10, f"{LINE}\n{own(9)}", "other", 8), (10, f"{LINE}\n{own(9)}", "h", 8), (11, f"{LINE}\nfew words", "h", 9), (12, own(8), None, 10)]
    docs = spark.createDataFrame(given, "doc_id long, text string, source string, n_chars long")
    out = dict(corpus_pipeline.STAGES)["quality"](spark, docs, "")
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = [tuple(r) for r in out.collect()]
    cleaned = [(i, f"{own(i)}\n\nlast é {own(i)[::-1]}", "h") for i in range(8)]
    want = [(*r, len(r[1])) for r in cleaned] + [(10, own(9), "h", len(own(9))), (10, f"{LINE}\n{own(9)}", "other", 8), (12, own(8), None, 10)]
    assert sorted(got, key=str) == sorted(want, key=str)

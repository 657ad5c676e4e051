"""Corpora from whole texts, against plain Python; texts are taken apart once."""

import collections
import re

import pytest

from papyra.functions import text as X
from papyra.operators import corpus
from papyra.plans.catalog import QUERIES

ODD = ["", None, "L'œuvre, déjà-vu; ŒUVRE Ⅷ x1y2", "a bb ccc dddd 1,000.5 3.", "œœ\U0001f600œœœ\U0001f600é", "of the sofa", "ÀÉÎ ñandú ÿ İstanbul straße", "\t\r\nnum num x", "éte qu'il aujourd'hui"]


def tokens(text, stop=(), min_len=2):
    t = re.sub(r"[0-9][0-9.,]*", " num ", (text or "").lower())
    return [w for w in re.sub(f"[^{X.LETTERS}]+", " ", t).split(" ") if w and len(w) >= min_len and w not in {*stop, *X.ELISIONS}]


@pytest.mark.parametrize("least", [0, 1, 2, 3, 5])
def test_normalised(spark, least):
    df = spark.createDataFrame(list(enumerate(ODD)), "i int, text string").select("i", X.normalised("text", ["num"], [], least).alias("t"))
    assert {r.i: r.t for r in df.collect()} == {i: tokens(t, ["num"], least) for i, t in enumerate(ODD)}


def test_build_reads_texts_once_and_keeps_order(spark):
    texts = ["ab cd ab ef", "cd ab gh cd", "ij kl mn op", "", "ab", "ef cd ab ab", None] + ["ab " * 3 + "cd"] * 2
    docs = spark.createDataFrame([(min(i, 7), t) for i, t in enumerate(texts)], "doc_id int, text string")
    final, report = corpus.build(docs, corpus.Setting("bloc", min_freq=3, least=3))
    kept = [(min(i, 7), tokens(t)) for i, t in enumerate(texts) if len(tokens(t)) >= 3]
    n = collections.Counter(w for _, ws in kept for w in ws)
    want = [(i, [w for w in ws if n[w] >= 3]) for i, ws in kept]
    want = sorted((i, ws) for i, ws in want if len(ws) >= 3)
    assert sorted((r.doc_id, r.tokens) for r in final.collect()) == want
    keys = {i for i, _ in want}
    assert tuple(report.first()) == (2, 1, len(keys), len(kept) - len(keys), len({w for _, ws in want for w in ws}))
    for frame in (final, report):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp" not in plan and "array_contains" not in plan


def test_min_freq_vocab_finds_runs_of_letters(spark, tmp_path):
    texts = ["ab" + "c" * (i % 7) + " " + "word " * 25 for i in range(60)] + ["word " * 19, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    frame = QUERIES["min_freq_vocab"](spark, str(tmp_path))
    got = {r.doc_id: (r.n_before, r.n_after) for r in frame.collect()}
    assert got == {i: (25 + (i % 7 > 0), 25 + (i % 7 > 0)) for i in range(60)}
    # a class of all but the letters tried each of 22 letters on every letter, which was nine tenths of the time
    once = spark.createDataFrame([("a",)], "text string").select(X.normalised("text"))
    assert "[^" not in once._jdf.queryExecution().optimizedPlan().toString()

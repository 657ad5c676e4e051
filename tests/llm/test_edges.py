"""Hostile, empty, null-key and repeated-key tables with clashing names through every operator and the pipeline, written to Parquet."""

import os

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from papyra.llm import ann, decontaminate, language_id, markov, mixing, repeats, sharding, simhash, toxicity
from papyra.llm import tokens as tk
from papyra.llm.queries import QUERIES, VOCABULARY

PASSAGE = " ".join(f"mot{i}" for i in range(60))
LONG = " ".join(f"long{i % 997}" for i in range(150_000))
TEXTS = [
    (1, PASSAGE + " fin un", "fr", "a"), (2, "debut " + PASSAGE, "fr", "b"), (2, "debut " + PASSAGE, "fr", "b"), (2, "an other text of this key", "en", "b"), (3, None, "en", None), (4, "", "en", "a"),
    (5, " \t\n", None, "a"), (None, "no id here", "en", "a"), (None, "no id here", "en", "a"), (6, LONG, "en", "c"), (7, "the cat!! IDIOT <|endoftext|> 123", "en", "c"), (8, "the cat!! IDIOT <|endoftext|> 123", "en", "c"),
    (9, "été 日本語 😀 \x85 a b", "de", "é"), (10, "x" * 300_000, "en", ""), ((1 << 63) - 1, "last. one? two!", "en", "a"), (-(1 << 62), "least", "fr", "b"),
]
#: Names that operators use for results, and within.
CLASHES = (
    "size long, source_size long, target double, taken long, epochs int, row string, _size int, _tie long, _weight double, n_bytes int, shard string, shard_depth int, root int, h long, bytes int, _key int, _text string, "
    "n_items int, best_item int, best_score double, fingerprint string, component_id long, fp long, th string, node long, c0 string, held_out int, score double, predicted int, lang_pred string, n_tokens int, kind int, bucket long, k int, toxic int, quality int, item_id int"
)


@pytest.fixture(scope="module", params=["hostile", "nulls", "empty"])
def folder(request, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp(request.param))
    docs = spark.createDataFrame([(*t, 7) for t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(7, 0, 1), (7, 1, 0), (1, 1, 0), (9, 0, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, PASSAGE), (2, None), (None, "x"), (3, ""), (3, "no id. here")], "item_id long, text string")
    vectors = spark.createDataFrame([(20, [1.0, 2.0]), (20, [1.0, 1.0]), (1, [0.0, 0.0]), (None, [1.0, 1.0]), (2, None), (3, [2.0, 1.0]), (40, [2.0, 1.0])], "vec_id long, embedding array<float>")
    for f in CLASHES.split(", "):
        name, kind = f.split()
        docs = docs.withColumn(name, F.lit(None if request.param == "nulls" else 1).cast(kind))
    if request.param == "nulls":
        docs, labels, bench, vectors = (d.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in d.schema)) for d in (docs, labels, bench, vectors))
    if request.param == "empty":
        docs, labels, bench, vectors = (d.limit(0) for d in (docs, labels, bench, vectors))
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench), ("embeddings", vectors)):
        df.coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return path, 0 if request.param == "empty" else len(TEXTS)


def put(spark, df, path, name):
    out = os.path.join(path, "out", name)
    df.write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries(spark, folder, name):
    path, n = folder
    got = put(spark, QUERIES[name](spark, path), path, name)
    if name == "op8_nearest":
        assert {(r.query_id, r.vec_id) for r in got.collect()} == ({(20, 3), (20, 40), (40, 3), (40, 20)} if n and got.count() else set())
    else:
        assert got.count() == n


def test_rows_keep_their_columns(spark, folder):
    path, n = folder
    docs, labels, bench = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    flagged = put(spark, decontaminate.flag(docs, bench), path, "flag")
    assert flagged.count() == n and set(flagged.columns) == set(docs.columns)
    kept = put(spark, simhash.one_of_each(docs), path, "one")
    assert kept.columns == docs.columns and kept.count() <= n
    clean = put(spark, toxicity.without_toxic(docs, toxicity.fit(docs, labels)), path, "clean")
    assert clean.columns == docs.columns
    mixed = put(spark, mixing.mix(docs, docs.columns), path, "mix")
    assert mixed.count() == n and len({c.lower() for c in mixed.columns}) == len(mixed.columns)
    rows = mixing.mix(mixing.quality_weights(mixing.packed(docs), labels), ["row"], weight="_weight", size="_size", tie="_tie")
    assert put(spark, mixing.materialise(rows), path, "rows").columns == docs.columns
    assert put(spark, sharding.shard(docs, docs.columns), path, "shard").count() == n


def test_pipeline(spark, folder):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    path, n = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    got = put(spark, corpus_pipeline.run(spark, path), path, "pipeline")
    assert set(docs.columns) <= set(got.columns)
    if not n:
        assert got.count() == 0


def test_other_tables_may_lack(spark):
    """Nothing to learn from, and nothing to compare with."""
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string, source string")
    none = spark.createDataFrame([], "doc_id long, text string, lang string, quality int, toxic int")
    assert {r.lang_pred for r in language_id.predict(docs, language_id.fit(none)).collect()} == {"und"}
    assert toxicity.fit(docs, none) is None
    assert markov.score(docs, F.lit(True)).count() == len(TEXTS)
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert tk.count_tokens(docs, public_tokenizers.path(VOCABULARY)).count() == len(TEXTS)
    assert repeats.remove_repeats(docs).count() == len(TEXTS)

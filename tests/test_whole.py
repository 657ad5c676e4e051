"""Queries that read whole tables, against brute force."""

import collections
import hashlib

from pyspark.sql import functions as F

from papyra.operators import learning
from papyra.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def test_decoys_of_all_articles(spark):
    own = collections.defaultdict(set)
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_suppkey").collect():
        own[r[0]].add(r[1])
    n = collections.Counter(x for labels in own.values() for x in labels)
    band = {x: (k >= 2) + (k >= 10) + (k >= 100) for x, k in n.items()}
    lot = lambda x: hashlib.md5(f"7|{x}".encode()).hexdigest()
    circle = {b: sorted((x for x in band if band[x] == b), key=lambda x: (lot(x), x)) for b in set(band.values())}
    want = {}
    for a, labels in own.items():
        c = circle[band[min(labels)]]
        at = int(lot(a)[:15], 16) % len(c)
        want[a] = next((x for x in c[at:] + c[:at] if x not in labels), None)
    got = {r.article: r.decoy for r in QUERIES["decoy_candidates"](spark, SF).collect()}
    assert len(got) > 1000 and got == want


def test_lda_takes_every_word_of_enough_documents(spark):
    common, rarer = [f"w{i}" for i in range(1 << 15)], ["seldom", "scarce"]
    docs = spark.createDataFrame([(i, common + rarer) for i in range(5)] + [(5, common), (6, common), (7, ["unique"])] + [(8, rarer)], "doc_id long, tokens array<string>")
    weight = {r.doc_id: r.weight for r in learning.lda(docs, k=2, max_iter=1).collect()}
    assert weight[8] > 0 and weight[7] == 0


def test_lda_takes_texts_apart_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def cut(text):
        calls.add(1)
        return text.split()

    docs = spark.createDataFrame([(i, "a b c" if i % 2 else "c d e") for i in range(40)], "doc_id long, text string").repartition(2)
    got = learning.lda(docs.select("doc_id", F.udf(cut, "array<string>")("text").alias("tokens")), k=2, max_iter=5).collect()
    assert len(got) == 40 and calls.value == 40

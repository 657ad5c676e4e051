"""Naive Bayes and multiple-instance learning against plain arithmetic, and nearest neighbours at the edges of doubles."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.llm import ann, language_id, toxicity
from papyra.llm import text as tx


def grams(t):
    """Hashed 1- to 3-grams of lower-case letters, runs of others being one blank."""
    cps, last = [], False
    for i, c in enumerate((t or "").lower()):
        if c.isalpha():
            cps.append(ord(c))
        elif last or i == 0:
            cps.append(32)
        last = c.isalpha()
    for n in (1, 2, 3):
        for i in range(len(cps) - n + 1):
            h = n
            for c in cps[i : i + n]:
                h = (h * 0x100000001B3 + c) & tx.M64
            yield int(tx.mix(np.array([h], np.uint64))[0]) >> 48


def test_posteriors_of_naive_bayes(spark):
    data = [(1, "the cat and the dog", "en"), (2, "A dog, a cat!", "en"), (3, "le chat et la mer", "fr"), (4, "un été à la plage", "fr"), (5, "der Hund", "de"), (6, "x", None), (7, None, "fr")]
    asked = ["the dog", "la plage", "Hund und cat", "été", "123", None, "", "zzz"]
    train = spark.createDataFrame(data, "doc_id long, text string, lang string")
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "doc_id long, text string")
    counts, sizes = collections.defaultdict(collections.Counter), collections.Counter()
    for _, t, g in data:
        if t is not None and g is not None:
            counts[g].update(grams(t))
            sizes[g] += 1
    want = []
    for t in asked:
        log = {}
        for g in sorted(sizes):
            total = sum(counts[g].values()) + 0.5 * language_id.BUCKETS
            log[g] = math.log(sizes[g] / sum(sizes.values())) + sum(math.log((counts[g][x] + 0.5) / total) for x in grams(t))
        top = max(log, key=log.get)
        has = any(c.isalpha() for c in t or "")
        want.append((top, 1 / sum(math.exp(x - log[top]) for x in log.values())) if has else ("und", 0.0))
    got = {r.doc_id: r for r in language_id.predict(docs, language_id.fit(train)).collect()}
    for i, (g, p) in enumerate(want):
        assert got[i].lang_pred == g and got[i].score == pytest.approx(p, abs=1e-4)


def test_too_many_languages_are_an_error(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError):
        language_id.fit(df)


def test_noisy_or_likelihood_and_gradient():
    # texts of sentences of features
    texts = [(1, [{0, 2}, {1}, set()]), (0, [{1}, {1, 2}]), (0, [set()]), (1, [{0}])]
    label = np.array([y for y, _ in texts])
    rows = [(i, j, f) for i, (_, ss) in enumerate(texts) for j, s in enumerate(ss) for f in s]
    d, s, f = (np.array(c) for c in zip(*rows))
    bags = toxicity.Bags(label, np.array([len(ss) for _, ss in texts]), d, s, f)
    rng = np.random.default_rng(0)
    x = rng.normal(size=4)

    def loss(x):
        out = 0.0
        for y, ss in texts:
            clean = math.prod(1 - 1 / (1 + math.exp(-(x[3] + sum(x[k] for k in s)))) for s in ss)
            out -= 4 / 2 / 2 * math.log(1 - clean if y else clean)
        return out / 4 + toxicity.RIDGE / 2 * (x[:3] @ x[:3])

    value, grad = bags.loss(x[:3], x[3])
    assert value == pytest.approx(loss(x))
    for k in range(4):
        e = np.eye(4)[k] * 1e-6
        assert grad[k] == pytest.approx((loss(x + e) - loss(x - e)) / 2e-6, rel=1e-5)
    names, w, b = toxicity.learn(label, np.array([len(ss) for _, ss in texts]), d, s, f)
    assert names.tolist() == [0, 1, 2] and w[0] > 1 > w[1] and bags.loss(w, b)[0] < 0.1


def test_scores_are_the_noisy_or(spark):
    model = (np.random.default_rng(1).normal(size=1 << toxicity.BITS).astype(np.float32), -2.0)
    texts = ["Bad dog. good cat! bad", "one two\nthree", "", None, "...", "same. same"]
    want = []
    for t in texts:
        ps = []
        for s in (t or "").lower().replace("!", ".").replace("\n", ".").split("."):
            ws = s.split()
            if ws:
                f = set()
                for w in ws:
                    whole, begin = tx.hash_word(w.encode()), tx.hash_word(w.encode()[: toxicity.PREFIX]) ^ 0x5BD1E995
                    f |= {int(tx.mix(np.array([h], np.uint64))[0]) >> (64 - toxicity.BITS) for h in (whole, begin)}
                ps.append(1 / (1 + math.exp(2 - sum(float(model[0][k]) for k in f))))
        want.append(1 - math.prod(1 - p for p in ps))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert [got[i].score for i in range(len(texts))] == pytest.approx(want)
    assert got[5].worst_sentence == 0


def test_nearest_of_large_and_uneven_vectors(spark):
    rng = np.random.default_rng(0)
    data = [(i, [float(x) for x in rng.normal(size=3) * 10.0 ** rng.integers(-3, 150)]) for i in range(60)]
    data += [(100 + i, [float(x) for x in rng.normal(size=2)]) for i in range(25)]
    data += [(200, [1e200, 1e200, 1.0]), (201, [1e300, -1e300, 0.0]), (220, [1e-320, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in data], "vec_id long, embedding array<double>, id string, v int")
    got = collections.defaultdict(list)
    for r in ann.search(df).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    with np.errstate(all="ignore"):
        for q, x in data:
            if q % 20:
                assert q not in got
                continue
            line = []
            for i, y in data:
                if i != q and len(y) == len(x):
                    s = float((np.array(y) * np.array(x)).sum())
                    line.append((math.inf if math.isnan(s) else -s, i))
            top = sorted(got[q])
            assert [r for r, _, _ in top] == list(range(1, min(20, len(line)) + 1))
            assert len({i for _, i, _ in top} & {i for _, i in sorted(line)[:20]}) >= 0.9 * len(top)


def test_nearest_in_blocks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK_BYTES", 400)
    rng = np.random.default_rng(5)
    data = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): r.vec_id for r in ann.search(df, block_rows=37).collect()}
    hit = 0
    for q, x in data[::20]:
        want = sorted((-float((np.array(y) * np.array(x)).sum()), i) for i, y in data if i != q)[:20]
        hit += len({got[q, r] for r in range(1, 21)} & {i for _, i in want})
    assert len(got) == 400 and hit >= 0.9 * 400

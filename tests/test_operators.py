"""Requests, models, corpora, trials and topics on toy rows."""

import collections
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.functions import measures as M
from papyra.functions import text as X
from papyra.operators import batching, corpus, labelling, models, ranking, requests, taxonomy, topics, trials
from papyra.plans.catalog import QUERIES


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_schemas_and_requests():
    one = requests.single(["a", "b"], justified=True)
    assert list(one["properties"]) == one["required"] == ["justification", "themes"] and one["additionalProperties"] is False
    lot = requests.batched(["a"], ["x", "y"])["properties"]["articles"]
    assert lot["minItems"] == lot["maxItems"] == 2 and lot["items"]["properties"]["article_id"]["enum"] == ["x", "y"]
    r = requests.request("m", "s", "list", "text", one, cached=True)
    other = requests.request("m", "s", "list", "else", one, cached=True)
    assert r["prompt_cache_key"] == other["prompt_cache_key"] != requests.prefix_key("m", "s", "another list")
    assert r["messages"][1]["content"].startswith("list") and "prompt_cache_key" not in requests.request("m", "s", "list", "t", one)
    json.dumps(r)


def test_answers(spark):
    lot = lambda *e: json.dumps({"articles": [{"article_id": i, "themes": t} for i, t in e]})
    data = [
        (1, lot(("x", ["a"]), ("y", ["b", "a"]))), (2, "{"), (3, lot(("x", ["a"]))), (4, lot(("x", ["a"]), ("z", ["a"]))),
        (5, lot(("x", ["a"]), ("y", []))), (6, lot(("x", ["q", "a", "a"]), ("y", ["b"]))), (7, None),
    ]
    df = spark.createDataFrame(data, "k int, reply string").withColumn("ids", F.array(F.lit("x"), F.lit("y")))
    got = {r.k: r for r in requests.answers(df, "reply", ["a", "b"], "ids").collect()}
    assert [got[k].problem for k in range(1, 8)] == [None, "not JSON", "articles", "articles", "number of themes", "unknown theme", "not JSON"]
    assert [(e.article_id, e.themes) for e in got[6].entries] == [("x", ["a"]), ("y", ["b"])] and [e.article_id for e in got[4].entries] == ["x"]
    single = requests.answers(spark.createDataFrame([('{"justification": "j", "themes": ["b"]}',)], "reply string"), "reply", ["a", "b"]).first()
    assert (single.justification, single.entries[0].themes, single.problem) == ("j", ["b"], None)


def test_unknown_labels_are_an_error(spark):
    names = spark.createDataFrame([("a",)], "label string")
    df = spark.createDataFrame([("a",), ("z",)], "label string")
    with pytest.raises(ValueError, match="z"):
        requests.require_known(df, names)
    assert requests.require_known(df.where("label = 'a'"), names).count() == 1


def test_label_lines_and_lead_in(spark):
    df = spark.createDataFrame([("1", "x", "p"), ("2", "x", "q"), ("3", "y", "p"), ("4", "y2", None)], "code string, label string, parent_label string")
    assert dict(rows(requests.label_lines(df))) == {"1": "1 : x (p)", "2": "2 : x (q)", "3": "3 : y", "4": "4 : y2"}
    long = spark.createDataFrame([(" ".join(["mot"] * 100),)], "t string")
    assert len(long.select(requests.led_in("t", 60)).first()[0].split()) == long.select(X.truncated("t", 60)).first()[0]


def test_cascade_with_a_lead_in(spark):
    def two_stage(items, labels):
        return {k: ["X"] if "x" in t.split() else ["Y"] for k, t in items}

    a = spark.createDataFrame([("i", k, t, 9) for k, t in enumerate(["x " + "w " * 90 + "p", "w " * 90 + "x q", "y"])], "g string, k int, t string, n long")
    second = labelling.keyword_client({"p": "P", "q": "Q"})
    got = {r.k: (r.branch, r.themes) for r in labelling.cascade(a, two_stage, second, {"X": ["P", "Q"], "Y": []}, "g", "k", "t", "n", lead_in=20).collect()}
    assert got == {0: ("X", ["P"]), 1: ("Y", ["Y"]), 2: ("Y", ["Y"])}
    routed = spark.createDataFrame([("b",), ("b",), ("a",), ("c",)], "branch string")
    assert labelling.largest_first(routed, {"a": ["1"], "b": ["2"], "c": [], "d": ["3"]}) == ["b", "a"]
    order = spark.createDataFrame([("q", 0), ("p", 1)], "key string, pos int")
    assert [r.key for r in labelling.in_order(spark.createDataFrame([("p",), ("q",)], "key string"), order, "key").collect()] == ["q", "p"]


def test_classify_packs_in_the_worker_that_calls(spark):
    calls = spark.sparkContext.accumulator(0)

    def client(items, labels):
        calls.add(1)
        return {k: ["A"] if "x" in t else ["Z"] for k, t in items}

    rows_of = [(g, k, "x" if k % 2 else None, 9) for g in ("a", "b", None) for k in range(60)] + [("c", 0, "x", 50_000), ("c", 1, "x", 1)]
    a = spark.createDataFrame([(g, k, t or "", n) for g, k, t, n in rows_of], "g string, k int, t string, n long")
    got = labelling.classify(a, client, ["A"], "g", "k", "t", "n", fixed=100)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
    assert sorted(rows(got), key=str) == sorted([(g, k, ["A"] if t else [], None) for g, k, t, _ in rows_of], key=str)
    assert calls.value == 3 * 3 + 2


def test_stub_classify_has_bounded_batches(spark, tmp_path):
    """Its texts go to Python in batches of a bounded number of bytes, and its result is read, not computed anew by who reads it."""
    spark.createDataFrame([(i, "s", "the und" if i % 2 else None) for i in range(30)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["stub_classify"](spark, str(tmp_path))
    assert "MapInPandas" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(rows(got)) == [("s", i, "A,C" if i % 2 else "") for i in range(30)]


def test_free_answers_when_strict_ones_are_refused():
    def strict(items, labels):
        raise labelling.Refused(400)

    assert labelling.with_fallback(strict, lambda items, labels: {k: ["A"] for k, _ in items})([(1, "")], ["A"]) == {1: ["A"]}


def test_label_texts_to_codes(spark):
    names = spark.createDataFrame([("sport", "1"), ("sport", "2"), ("politique", "3")], "label string, code string")
    got = labelling.label_codes(spark.createDataFrame([("sport",), ("politics",), ("?",)], "label string"), names, aliases={"politics": "politique"})
    assert sorted(rows(got), key=str) == sorted([("sport", "1"), ("sport", "2"), ("politics", "3"), ("?", None)], key=str)


def test_length_sorted_batches():
    sizes = []
    got = batching.length_sorted(["ccc", "a", "bb", ""], 2, lambda b: (sizes.append([len(x) for x in b]), [x.upper() for x in b])[1])
    assert got == ["CCC", "A", "BB", ""] and sizes == [[0, 1], [2, 3]]


def test_models(spark):
    def encoder():
        return lambda texts: [[t.count("a"), t.count("b"), 1.0] for t in texts], lambda t: len(t) + 1, ["A", "B", "C"]

    def embedder():
        return lambda texts: np.array([[len(t), t.count("q")] for t in texts])

    def tagger():
        return lambda t: [(w, "NOUN" if w[0].isupper() else "X") for w in t.split()]

    docs = spark.createDataFrame([(1, "aaa b"), (2, "bb"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in models.classified(docs, encoder, length=4).collect()}
    p = np.exp([3, 1, 1]) / np.exp([3, 1, 1]).sum()
    assert (got[1].label, got[1].score, got[1].second, got[1].second_score) == ("A", round(p[0], 4), "B", round(p[1], 4))
    assert (got[1].n_words, got[1].n_tokens, got[1].encoded_share) == (2, 6, 0.667) and got[3].label == "C" and got[3].encoded_share == 1.0
    assert {r.doc_id: r.embedding for r in models.embeddings(docs, embedder, prefix="query: ").collect()}[2] == [9.0, 1.0]
    assert {r.doc_id: r.tokens for r in models.lemmas(docs.where("doc_id = 1").union(spark.createDataFrame([(4, "Un deux A1 Quai")], docs.schema)), tagger, ("NOUN",)).collect()} == {1: [], 4: ["un", "quai"]}


def test_transcription_and_its_cost(spark):
    def reader():
        def read(image):
            if image == b"bad":
                raise RuntimeError("no")
            return f" {image.decode()} ", 100, 10

        return read

    data = [("p", "B1", "old", b"new", False), ("p", "B2", "T", b"x", True), ("p", "B3", "kept", b"bad", False), ("p", "B4", "none", None, False)]
    log = models.transcribed(spark.createDataFrame(data, "page string, block_id string, text string, crop binary, is_title boolean"), reader, ["page", "block_id"])
    got = {r.block_id: (r.text_new, r.error) for r in log.collect()}
    assert got == {"B1": ("new", None), "B2": ("T", None), "B3": ("kept", "no"), "B4": ("none", None)}
    cost = models.running_cost(log, ["page"]).first()
    assert (cost.prompt_tokens, cost.completion_tokens, cost.n_errors) == (100, 10, 1) and cost.cost == pytest.approx(110 / 1e6 * 0.15)
    blocks = spark.createDataFrame([("p", "B1", "own", 0, 0, 10, 10), ("p", "B2", "own", 900, 900, 950, 950)], "page string, block_id string, text string, l int, t int, r int, b int")
    found = spark.createDataFrame([("p", "far", 5, 5, 500, 500), ("p", "near", 0, 0, 10, 12)], "page string, text string, l int, t int, r int, b int")
    assert {r.block_id: r.text for r in models.aligned(blocks, found, ["page"]).collect()} == {"B1": "near", "B2": "own"}


def test_corpora(spark):
    texts = ["un deux trois un deux trois", "un deux", "", "un deux trois quatre rare"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got, report = corpus.build(docs, corpus.Setting("bloc", min_len=2, min_freq=2, least=4))
    assert {r.doc_id: r.tokens for r in got.collect()} == {0: "un deux trois un deux trois".split()}
    assert tuple(report.first()) == (1, 1, 1, 1, 3)
    every, report = corpus.build(docs, corpus.raw(corpus.Setting("bloc")))
    assert every.count() == 3 and report.first().n_empty == 1
    assert set(corpus.references()) == {"article_filtered", "article_raw", "bloc_filtered", "bloc_raw"} and corpus.Setting().least_tokens == 20


def test_npmi_of_rare_words(spark):
    """No constant is added to probabilities, however small they are."""
    lit = lambda *v: (F.lit(x) for x in v)
    n = 1_000_000
    values = spark.range(1).select(M.npmi(*lit(1, 1, 1, n)), M.npmi(*lit(2, 2, 1, 2 * n)), M.npmi(*lit(1, 1, 0, n)), M.npmi(*lit(5, 5, 5, 5)), M.npmi(*lit(1, 1, 1, 10**11))).first()
    p = 0.5e-6
    assert values[0] == pytest.approx(1.0) and values[1] == pytest.approx(math.log(p / 1e-12) / -math.log(p)) and values[1] == pytest.approx(0.904, abs=1e-3)
    assert tuple(values)[2:] == (-1.0, 1.0, -1.0)


def test_topic_coherence_rounds_the_mean(spark):
    docs = ["a b c", "a b", "a c", "b", "d"]
    top = spark.createDataFrame([(0, w) for w in "abc"] + [(1, "d")] + [(2, "a"), (2, "d")], "topic int, word string")
    pairs = spark.createDataFrame([(i, w) for i, d in enumerate(docs) for w in d.split()], "doc int, word string")
    got = dict(rows(topics.npmi(top, pairs, 5)))
    n = collections.Counter(w for d in docs for w in d.split())
    value = lambda x, y, k: math.log(k / 5 / (n[x] / 5 * n[y] / 5)) / -math.log(k / 5)
    assert got == {0: pytest.approx(round((value("a", "b", 2) + value("a", "c", 2) + value("b", "c", 1)) / 3, 4)), 1: 0.0, 2: -1.0}


def test_counted_words(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["é"])], "k int, words array<string>")
    assert sorted(rows(topics.counted(df, "words", "k"))) == [(1, "a", 1), (1, "b", 2), (4, "é", 1)]
    words = topics.counted(df, "words", "k").union(spark.createDataFrame([(9, "b", 1)], "k int, word string, n long"))
    assert {r.word for r in topics.common(words, 2, "k").collect()} == {"b"}
    assert spark.range(1).select(X.class_words(F.lit("Les été_x abc ab a1bc l'ÉTÉ"), ["les"])).first()[0] == ["abc", "été"]


def test_run_stability(spark):
    a = spark.createDataFrame([(0, w) for w in "abcd"] + [(1, w) for w in "efgh"], "topic int, word string")
    b = spark.createDataFrame([(7, w) for w in "efgx"] + [(8, w) for w in "abcx"] + [(9, w) for w in "abyz"], "topic int, word string")
    assert topics.stability(a, b) == [(0, 8, 0.6), (1, 7, 0.6)]
    with pytest.raises(ValueError):
        topics.stability(a, b, most=2)


def test_matching_takes_groups_by_size():
    table = [(0, 0, 5), (0, 1, 9), (1, 1, 8), (1, 0, 1), (-1, 0, 50), (0, 2, 1)]
    assert trials.match_groups(table) == {1: 0, 0: 1, 2: 0}
    assert trials.diagonal_order([(0, 0, 5), (0, 1, 9), (1, 1, 8), (1, 0, 1), (0, 2, 1)]) == ([0, 1], [1, 0, 2])


def test_running_sums_and_medians(spark):
    rng = np.random.default_rng(0)
    data = [("ab"[i % 2], int(v)) for i, v in enumerate(rng.integers(0, 50, 401))] + [("c", None), ("c", 3)]
    df = spark.createDataFrame(data, "g string, v int").repartition(5)
    got = {r.g: (r.n, r["median"], r.upper) for r in ranking.quantiles(df, ["g"], "v").collect()}
    for g in "abc":
        own = sorted(v for x, v in data if x == g and v is not None)
        assert got[g] == (len(own), float(np.median(own)), own[len(own) // 2])
    line = ranking.cumulative(spark.range(100).select((F.col("id") % 10).alias("k"), "id"), [], [F.desc("k"), F.col("id")], "id").orderBy("rank").collect()
    assert [r.rank for r in line] == list(range(1, 101)) and line[-1].upto == 4950 and all(r["all"] == 4950 for r in line)


def test_deep_hierarchies(spark):
    chain = [("c0", None)] + [(f"c{i}", f"c{i - 1}") for i in range(1, 12)]
    e = spark.createDataFrame([*chain, ("x", "y"), ("y", "x"), ("c5", "c9")], "code string, parent string")
    got = {r.code: r.root for r in taxonomy.rollup(e).collect()}
    assert got["c11"] == "c0" and got["x"] is None
    leaves = spark.createDataFrame([("a", "r"), ("b", "r"), ("c", "s")], "code string, l1 string")
    assert {r.l1: r.codes for r in taxonomy.families(leaves).collect()} == {"r": ["a", "b"], "s": ["c"]}


def test_trial_kits(spark):
    uses = spark.createDataFrame([(a, x) for a in range(40) for x in (a % 7, a % 3 + 10)], "article long, label long").distinct()
    bands = uses.groupBy("label").count().select("label", X.band("count").alias("band"))
    own = collections.defaultdict(set)
    for a, x in rows(uses):
        own[a].add(x)
    items = trials.kit(uses, bands, 20, "1").collect()
    assert 5 < len(items) <= 20 and {r.is_true for r in items} == {True, False}
    assert all((r.label in own[r.article]) == r.is_true for r in items) and sorted(r.item for r in items) == [f"B{i:03d}" for i in range(1, len(items) + 1)]


def test_shades(spark):
    got = spark.range(1).select(M.heat(F.lit(4), F.lit(16)), M.heat(F.lit(0), F.lit(0)), M.fill(F.lit(0.3)), M.fill(F.lit(2.0))).first()
    assert tuple(got) == pytest.approx((0.5, 0.0, 0.55, 1.0))

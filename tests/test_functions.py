"""The invariants of the text, statistics, batching and hierarchy functions."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyra.functions import measures as M
from papyra.functions import text as X
from papyra.operators import batching, labelling, taxonomy, trials


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize(("n", "band"), [(0, "hapax"), (1, "hapax"), (2, "rare"), (9, "rare"), (10, "medium"), (99, "medium"), (100, "frequent"), (14126, "frequent")])
def test_band(spark, n, band):
    assert one(spark, X.band("n"), n=n) == band


def test_excerpt(spark):
    assert one(spark, X.excerpt("t"), t="a\n\tb   c") == "a b c"
    long = one(spark, X.excerpt("t"), t=" ".join(["w"] * 500))
    assert long.endswith(" […]") and len(long.split()) == 181


def test_noise(spark):
    f = lambda s: one(spark, X.is_noise(X.words("t")), t=s)
    assert f("a b c d e trois quatre cinq six sept") and not f("a b c d mot trois quatre cinq six sept")
    assert not f("un deux mot trois quatre cinq six sept huit neuf a b c d e") and not f("")


def test_normalised(spark):
    assert one(spark, X.normalised("t", ["le"], ["au lieu de", "lieu"], 2), t="Au lieu de l'été 1 234,5 Le Qu'hui") == ["été", "num", "num"]


def test_truncated(spark):
    text = " ".join(["mot"] * 100)
    n = 100
    while n > 1 and len(" ".join(["mot"] * n)) // 3.5 + 1 > 60:
        n = int(n * 0.8)
    assert one(spark, X.truncated("t", 60), t=text) == n and one(spark, X.truncated("t", 0), t=text) == 100


@pytest.mark.parametrize(("k", "n"), [(33, 69), (0, 58), (60, 60), (1, 60), (500, 1000), (5, 10), (0, 0), (28, 40)])
def test_wilson(spark, k, n):
    lo, hi = (one(spark, c, k=k, n=n) for c in M.wilson(F.col("k"), F.col("n")))
    p = k / n if n else 0
    assert 0 <= lo <= p + 1e-12 and p - 1e-12 <= hi <= 1
    if (k, n) == (28, 40):
        assert round(100 * lo, 1) == 54.6 and round(100 * hi, 1) == 81.9


def test_sets(spark):
    e = F.array().cast("array<int>")
    row = spark.range(1).select(M.jaccard(e, e), M.overlap_class(e, e), M.npmi(F.lit(5), F.lit(5), F.lit(5), F.lit(5)), M.npmi(F.lit(5), F.lit(5), F.lit(0), F.lit(9))).first()
    assert tuple(row) == (1.0, "identical", 1.0, -1.0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 60_000), max_size=200), st.sampled_from([0, 8000]))
def test_lots(tokens, fixed):
    lots = batching.greedy_lots(np.array(tokens), fixed)
    assert len(lots) == len(tokens) and (np.diff(lots) >= 0).all() and (np.diff(lots) <= 1).all()
    for lot in set(lots.tolist()):
        own = [t for t, x in zip(tokens, lots) if x == lot]
        assert len(own) <= 25 and (len(own) == 1 or fixed + sum(t + 15 for t in own) <= 40_000)


def test_with_lots_streams_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(g, i, int(t)) for g in "abc" for i, t in enumerate(rng.integers(1, 9000, 300))]
    got = batching.with_lots(spark.createDataFrame(rows, "g string, i int, t long").repartition(7), "g", "i", "t", 1000).collect()
    for g in "abc":
        own = sorted((r.i, r.t, r.lot) for r in got if r.g == g)
        assert [x[2] for x in own] == batching.greedy_lots(np.array([x[1] for x in own]), 1000).tolist()


def test_taxonomy(spark):
    e = spark.createDataFrame([("r", None), ("a", "r"), ("b", "r"), ("c", "a"), ("x", "gone"), ("y", "z"), ("z", "y")], "code string, parent string")
    assert {r.code: r.root for r in taxonomy.rollup(e).collect()} == {"r": "r", "a": "r", "b": "r", "c": "r", "x": None, "y": None, "z": None}
    assert {r.code for r in taxonomy.leaves(e, 3).collect()} == {"b", "c"}


def test_client_failures():
    calls = []

    def client(items, labels):
        calls.append(len(items))
        if any(k == 3 for k, _ in items):
            raise labelling.Refused(400)
        return {k: ["A", "A", "nope"] for k, _ in items}

    got = labelling.by_halves(client, [(k, "") for k in range(6)], ["A"])
    assert got[3] is None and all(labelling.valid(got[k], {"A"}) == ["A"] for k in (0, 1, 2, 4, 5))
    waits, states = [], iter([labelling.Refused(429, 7.0), labelling.Refused(500), labelling.Refused(None)])

    def flaky(items, labels):
        for e in states:
            raise e
        return {}

    labelling.patient(flaky, sleep=waits.append)([], [])
    assert waits == [7.0, 4.0, 6.0]


def test_cascade(spark):
    a = spark.createDataFrame([("i", k, t, 5) for k, t in enumerate(["x p", "x q", "y", "-"])], "g string, k int, t string, n long")
    first, second = labelling.keyword_client({"x": "X", "y": "Y"}), labelling.keyword_client({"p": "P", "q": "Q"})
    got = {r.k: r.themes for r in labelling.cascade(a, first, second, {"X": ["P", "Q"], "Y": []}, "g", "k", "t", "n").collect()}
    assert got == {0: ["P"], 1: ["Q"], 2: ["Y"], 3: []}




def test_identifiers_and_periods(spark):
    assert one(spark, X.ark_of("t"), t="see https://x.org/ark:/12148/bpt6k4109000.item") == "ark:/12148/bpt6k4109000"
    assert one(spark, X.ark_of("t"), t="none") is None
    assert one(spark, X.image_url("https://x.org/iiif/", F.col("a"), F.col("p")), a="ark:/1/b", p=3) == "https://x.org/iiif/ark:/1/b/f3/full/full/0/native.jpg"
    assert one(spark, X.period(F.col("y")), y=1898) == "1880-1899" and one(spark, X.period(F.col("y")), y=1900) == "1900-1919"
    assert one(spark, X.page_number("n"), n="X0012.xml") == 12

"""The pipeline's near-duplicates against brute-force five-word Jaccard similarity."""

import itertools

import numpy as np
import pytest
from llm_brute import brute_jaccard

from papyra.llm import shingles, simhash
from papyra.llm import text as tx

SF = "/root/testdata/sf0.01"


def kept(df):
    return sorted(r.doc_id for r in simhash.one_of_each(df).collect())


def test_sf(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_jaccard((r.doc_id, r.text) for r in df.collect())
    assert kept(df) == sorted(set(want.values()))


@pytest.mark.parametrize("most", [shingles.COMPONENT, 1, 700])
def test_crowds(spark, monkeypatch, most):
    """Edited copies of a few texts, chained and spread, with a common passage; more sharers than are compared pairwise."""
    monkeypatch.setattr(shingles, "COMPONENT", most)
    monkeypatch.setattr(shingles, "PIVOTS", 2 if most == 1 else 8)
    rng = np.random.default_rng(3)
    base = [[f"w{x}" for x in rng.integers(0, 5000, n)] for n in (40, 60, 61, 90)]
    line = [f"line{i}" for i in range(12)]
    data = [(0, ""), (1, None), (2, "one two"), (3, "One  two"), (4, "one two three")]
    for i in range(5, 260):
        w = list(base[i % 4])
        for at in rng.integers(0, len(w), rng.integers(0, 4)):
            w[at] = f"x{rng.integers(0, 10**6)}"
        data.append((i, " ".join(line * (i % 3) + w)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = brute_jaccard(data)
    assert 20 < len(set(want.values())) < 250
    assert kept(df) == sorted(set(want.values()))


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(8)
    sets = [rng.choice(2000, n, replace=False).astype(np.uint64) for n in (0, 1, 31, 32, 33, 500, 1500)]
    sets = [np.unique(tx.mix(x)) for x in sets]
    data, at = shingles._bitmaps(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    bits = [data[a:b].tobytes() for a, b in itertools.pairwise(at.tolist())]
    for (x, p), (y, q) in itertools.product(zip(sets, bits), repeat=2):
        assert shingles._differ(p, q) <= len(np.setxor1d(x, y)) and len(p) * 8 >= 2 * len(x)


@pytest.fixture
def tables(monkeypatch):
    """Rows of every table that is written: (name, columns, rows)."""
    seen, write = [], shingles.store.written

    def written(df, name):
        out = write(df, name)
        seen.append((name, out.columns, out.count()))
        return out

    monkeypatch.setattr(shingles.store, "written", written)
    return seen


def test_phrases_of_frequent_words_are_not_indexed(spark, monkeypatch, tables):
    """Texts that share chance phrases of four frequent words, which the sample is too small to list."""
    monkeypatch.setattr(shingles, "SAMPLE", 16)
    rng = np.random.default_rng(5)
    data = [(i, " ".join([f"of{x}" for x in rng.integers(0, 4, 10)] + [f"u{i}x{k}" for k in range(40)])) for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert kept(df) == list(range(300))
    assert [n for name, _, n in tables if name == "sharers"] == [0]


def test_large_component_reads_the_sets_of_likely_links(spark, monkeypatch, tables):
    """Unlike texts with one common line and few copies, all in components too large for a task."""
    common = shingles.common
    monkeypatch.setattr(shingles, "common", lambda rows: tuple(np.zeros_like(x) for x in common(rows)))  # shingles in the order of their hashes
    monkeypatch.setattr(shingles, "FEW", 4)
    monkeypatch.setattr(shingles, "COMPONENT", 1)
    line = [f"line{i}" for i in range(12)]
    texts = [[*line, *(f"u{i}x{k}" for k in range(30))] for i in range(60)]
    data = [(i, " ".join(w)) for i, w in enumerate(texts)] + [(100 + i, " ".join([*texts[i][:-1], "edited"])) for i in range(5)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = brute_jaccard(data)
    assert kept(df) == sorted(set(want.values())) == list(range(60))
    assert max(n for name, _, n in tables if name == "wanted") > 30
    sets = [n for _, columns, n in tables if "set" in columns]
    assert sets and max(sets) <= 10

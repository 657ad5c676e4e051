"""Decontamination against BM25 computed plainly from words."""

import collections
import math
import re

import numpy as np
import pytest

from papyra.llm import decontaminate

SF = "/root/testdata/sf0.01"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(s):
    return re.findall(rb"[a-z0-9\x80-\xff]+", s.encode().translate(LOWER))


class Plain:
    """BM25 over items, threshold and overlaps, in dictionaries."""

    def __init__(self, items):
        self.items = {i: words(t) for i, t in items}
        self.parts = {}
        for i, t in items:
            sentences = [words(x) for x in re.split(r"[.!?\n]", t)]
            sentences = [x for x in sentences if x]
            self.parts[i] = ([w for x in sentences[:-1] for w in x] or (sentences[-1] if sentences else []), sentences[-1] if sentences else [])
        self.df = collections.Counter(w for ws in self.items.values() for w in set(ws))
        self.mean = sum(map(len, self.items.values())) / len(self.items)
        self.step = max(64, max(map(len, self.items.values())))

    def impacts(self, i):
        ws = self.items[i]
        out = {}
        for w, tf in collections.Counter(ws).items():
            idf = math.log(1 + (len(self.items) - self.df[w] + 0.5) / (self.df[w] + 0.5))
            out[w] = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / self.mean))
        all_ = sum(out.values())
        return {w: x / all_ for w, x in out.items()}

    def judge(self, text):
        ws = words(text or "")
        best = {}
        chunks = max(1, -(-len(ws) // self.step))
        for p in range(-1, chunks):
            passage = ws[max(0, p) * self.step : (p + 2) * self.step]
            have = set(passage)
            grams = {n: {tuple(passage[j : j + n]) for j in range(len(passage) - n + 1)} for n in (1, 2, 3)}
            for i in self.items:
                s = sum(x for w, x in self.impacts(i).items() if w in have)
                shares = []
                for part in self.parts[i]:
                    n = min(3, len(part))
                    own = {tuple(part[j : j + n]) for j in range(len(part) - n + 1)} if n else set()
                    shares.append(sum(g in grams[n] for g in own) / len(own) if own else 0)
                if s >= 0.5 and shares[0] >= 0.6 and shares[1] >= 0.5:
                    best[i] = max(best.get(i, 0), min(s, 1.0))
        if not best:
            return 0, None, 0.0
        top = max(best.values())
        return len(best), min(i for i, s in best.items() if s >= top - 1e-12), round(top, 9)


def judged(df, bench, **more):
    out = decontaminate.flag(df, bench, **more)
    return sorted((r.doc_id, r.n_items, r.best_item, round(r.best_score, 9)) for r in out.collect())


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab, 9)) + ". " + " ".join(rng.choice(vocab, 4)) + "!") for i in range(70)]
    items += [(70, "one sentence only w1 w2"), (71, "w3"), (72, items[3][1])]
    texts = []
    for i in range(60):
        part = items[rng.integers(73)][1].split()
        part = [w if rng.random() > 0.15 else "x" for w in part]
        texts.append((i, " ".join([*rng.choice(vocab, rng.integers(0, 120)), *part, *rng.choice(vocab, rng.integers(0, 90))])))
    texts += [(60, None), (61, ""), (62, ". ! ?"), (63, "W3"), (64, items[5][1].upper()), (64, items[6][1])]
    return items, texts


def test_scores_are_those_of_bm25(spark, made):
    items, texts = made
    plain = Plain(items)
    want = sorted((i, *plain.judge(t)) for i, t in texts)
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([*items, (None, "w1 w2 w3"), (99, None)], "item_id long, text string")
    assert sum(n > 0 for _, n, _, _ in want) > 20
    # however many parts the index has
    for size in (1 << 20, 1000):
        assert judged(docs, bench, index_bytes=size) == want


def test_wand_is_complete():
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(80)]
    items = [" ".join(rng.choice(vocab, rng.integers(2, 30))) for _ in range(300)]
    index = decontaminate.Index(list(range(300)), [s.encode() for s in items])
    queries = np.full((200, 40), -1)
    for q in queries:
        own = rng.choice(len(index.most), rng.integers(0, 40), replace=False)
        q[: len(own)] = np.sort(own)
    got = {(a, b): s for a, b, s in zip(*(x.tolist() for x in index.wand(queries)))}
    want = {}
    for a, q in enumerate(queries):
        score = np.zeros(300)
        for t in q[q >= 0]:
            p = slice(index.ptr[t], index.ptr[t + 1])
            score[index.item[p]] += index.impact[p]
        want |= {(a, int(b)): score[b] for b in np.flatnonzero(score >= decontaminate.THRESHOLD)}
    assert got == pytest.approx(want) and len(want) > 100


def test_planted_items(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [" ".join(r.text.split()) for r in bench.collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id for r in docs.collect() if any(t in " ".join(r.text.split()) for t in items)}
    got = decontaminate.flag(docs, bench)
    assert {r.doc_id for r in got.where("n_items > 0").collect()} == want and len(want) > 5


def test_edges(spark, made):
    items, _ = made
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(None, items[0][1], 1, "a", None), (1, None, 2, "b", 3.0)], "doc_id long, text string, N_ITEMS int, t string, part double")
    out = decontaminate.flag(docs, bench)
    assert out.columns == ["doc_id", "text", "t", "part", "n_items", "best_item", "best_score"]
    assert sorted((r.n_items, r.best_item) for r in out.collect()) == [(0, None), (1, 0)]
    assert decontaminate.flag(docs.limit(0), bench).count() == 0
    assert {r.n_items for r in decontaminate.flag(docs, bench.limit(0)).collect()} == {0}


def test_a_long_text_is_searched_in_pieces(spark, made):
    items, _ = made
    filler = " ".join(f"f{i}" for i in range(3000))
    text = f"{filler} {items[7][1]} {filler} {items[9][1]} {filler}"
    docs = spark.createDataFrame([(1, text), (2, "y" * 50_000), (3, "y " * 30_000)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    n = Plain(items).judge(text)[0]  # items 7 and 9, and any that they hold
    for piece in (1 << 20, 4096, 1000):
        assert [n for _, n, _, _ in judged(docs, bench, piece=piece)] == [n, 0, 0] and n >= 2

"""The hidden Markov model against sums over all paths, and its scores against plain arithmetic."""

import collections
import itertools
import math
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.llm import markov
from papyra.llm import text as tx

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def model(k=3, c=4, seed=3):
    rng = np.random.default_rng(seed)
    p = lambda *s: (lambda x: x / x.sum(-1, keepdims=True))(rng.random(s))
    return markov.Model(p(k), p(k, k), np.ascontiguousarray(p(k, c).T))


def path(m, s, z):
    return m.initial[z[0]] * m.emit[s[0], z[0]] * math.prod(m.move[a, b] * m.emit[o, b] for a, b, o in zip(z, z[1:], s[1:]))


def brute(m, s):
    return sum(path(m, s, z) for z in itertools.product(range(len(m.move)), repeat=len(s)))


def test_forward_sums_over_paths():
    m = model()
    seqs = [np.array([0, 3, 1, 2]), np.array([2, 2])]
    got = markov.forward(m, np.concatenate(seqs), np.array([0] * 4 + [1] * 2), 2)
    assert got == pytest.approx([math.log10(brute(m, s)) for s in seqs])
    assert sum(brute(m, np.array(s)) for s in itertools.product(range(4), repeat=3)) == pytest.approx(1)


@pytest.mark.parametrize("segment", [1, 2, 3, 100])
def test_counts_are_those_of_whole_texts(monkeypatch, segment):
    """Wherever texts are cut, no transition is lost."""
    monkeypatch.setattr(markov, "SEGMENT", segment)
    monkeypatch.setattr(markov, "BATCH", 3)
    m, rng = model(), np.random.default_rng(1)
    seqs = [rng.integers(0, 4, n) for n in (7, 1, 2, 5, 6, 3)]
    initial, move, emit, loglik = np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3)), 0.0
    for s in seqs:
        total = brute(m, s)
        loglik += math.log(total)
        for z in itertools.product(range(3), repeat=len(s)):
            w = path(m, s, z) / total
            initial[z[0]] += w
            for a, b in itertools.pairwise(z):
                move[a, b] += w
            for o, a in zip(s, z):
                emit[o, a] += w
    got = markov.expect(m, seqs)
    for x, y in zip(got, (initial, move, emit, loglik)):
        assert x == pytest.approx(y)


def test_the_likelihood_rises():
    m, rng = model(), np.random.default_rng(2)
    seqs, old = [rng.integers(0, 4, n) for n in (2000, 1500, 30)], None
    for _ in range(6):
        *counts, ll = markov.expect(m, seqs)
        assert old is None or ll > old - 0.5
        m, old = markov.Model.of_counts(*counts), ll


def test_score_with_classes_tails_and_rare_words(spark, monkeypatch):
    """Word by word: head words by rank, others by the class of their last bytes and their share of it."""
    for name, value in (("HEAD", 3), ("COMMON", 5), ("STATES", 2), ("START_ROUNDS", 2)):
        monkeypatch.setattr(markov, name, value)
    caught = []
    plain = markov._score
    monkeypatch.setattr(markov, "_score", lambda shared: (caught.append(pickle.loads(pickle.dumps(shared.value[1]))), plain(shared))[1])
    data = [(1, "a a a b b c the THE dog dogs"), (2, "a b c c cat cats rat"), (3, "unseen words a b dogs rat rat"), (3, "unseen words a b dogs rat rat"), (4, None), (None, "rat a zebra")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in markov.score(docs, F.coalesce(F.col("doc_id") == 3, F.lit(False)), passes=1).collect():
        got[r.doc_id].append(r)
    m = caught[0]

    def words(t):
        return [*(t or "").encode().translate(LOWER).split(), None]

    count = collections.Counter(w for i, t in data if i != 3 for w in words(t))
    shape = lambda w: 0 if w is None else tx.hash_word(w[-markov.TAIL_BYTES :]) % markov.SHAPES
    key = lambda w: int(np.uint64(markov.END if w is None else tx.hash_word(w)).view(np.int64))
    ranked = sorted(count, key=lambda w: (w is not None, -count[w], key(w)))
    head = ranked[:3]
    group = collections.defaultdict(lambda: [0, 0])
    for w in ranked[3:]:
        group[shape(w)][0] += count[w]
        group[shape(w)][1] += 1
    for i, t in data:
        ws = words(t)
        classes = [head.index(w) if w in head else 3 + shape(w) for w in ws]
        want = math.log10(brute(m, classes))
        for w in ws:
            if w not in head:
                n, v = group[shape(w)]
                want += math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1)))
        assert all(r.score == pytest.approx(want) and r.n_known == sum(w in count for w in ws) for r in got[i])
    assert len(got[3]) == 2 and len(got[None]) == 1

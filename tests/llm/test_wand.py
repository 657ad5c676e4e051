"""How much work the cursors of the benchmark's index do, and that they lose no item on the way."""

import numpy as np
import pytest

from papyra.llm import decontaminate


def made(n, words, seed):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(words)]
    index = decontaminate.Index(list(range(n)), [" ".join(rng.choice(vocab, rng.integers(2, 30))).encode() for _ in range(n)])
    queries = np.full((100, 40), -1)
    for q in queries:
        own = rng.choice(len(index.most), rng.integers(0, min(40, len(index.most) + 1)), replace=False)
        q[: len(own)] = np.sort(own)
    return index, queries


@pytest.mark.parametrize(("n", "words"), [(20, 120), (200, 2000), (300, 80)])
def test_a_cursor_passes_each_posting_once(monkeypatch, n, words):
    index, queries = made(n, words, 5)
    moves, seek = [], decontaminate.Index._seek
    monkeypatch.setattr(decontaminate.Index, "_seek", lambda self, term, *to: moves.append(len(term)) or seek(self, term, *to))
    index.wand(queries)
    assert sum(moves) <= np.diff(index.ptr)[queries[queries >= 0]].sum()


@pytest.mark.parametrize(("n", "words"), [(1, 40), (16, 80), (33, 80), (17_000, 300)])
def test_items_are_those_of_all_postings(n, words):
    index, queries = made(n, words, 6)
    got = {(a, b): s for a, b, s in zip(*(x.tolist() for x in index.wand(queries)))}
    want = {}
    for a, q in enumerate(queries):
        score = np.zeros(n)
        for t in q[q >= 0]:
            p = slice(index.ptr[t], index.ptr[t + 1])
            score[index.item[p]] += index.impact[p]
        want |= {(a, int(b)): score[b] for b in np.flatnonzero(score >= decontaminate.THRESHOLD)}
    assert got == pytest.approx(want) and want

"""Plain versions that several tests compare with."""

import collections
import itertools

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def brute_jaccard(data):
    """The least id of each text's group."""
    sets = {}
    for i, t in data:
        w = (t or "").encode().translate(LOWER).split()
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s or [None]:
            where[x].append(i)
    shared = collections.Counter(p for ids in where.values() for p in itertools.combinations(sorted(ids), 2))
    for (a, b), n in shared.items():
        if not sets[a] and not sets[b] or 9 * n >= 4 * (len(sets[a]) + len(sets[b])):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}

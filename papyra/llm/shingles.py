"""Near-copies by the exact Jaccard similarity of word-shingle sets.

Texts of equal sets collapse first. Shingles are put in one order, those last that
a sample shares widely or whose words are frequent enough to meet by chance, and each
set is indexed under its first n - ceil(0.8 n) + 1 shingles: two sets at or above 0.8
share one of these (prefix filter), and what follows their first shared one must
suffice for 0.8 (positional filter). The order only decides how many candidates there
are; any order loses none. Pairs that pass are compared by bitmaps of the parity of their
sets' hashes, which differ in no more bits than the sets do in shingles. What is
left, more than FEW sharers of one shingle, and what the caller links, form
candidate components, which hold every true link. A component's sets meet once, and
links are verified there, by counts of whole numbers, before groups are formed.

Within a component of up to COMPONENT shingles the links are searched breadth-first by
one task that holds its sets. A larger one is never in one task: its sets are compared
with a few pivots first, each a join by component; sets alike a pivot have a group, and
of the other candidate pairs only those of different groups are compared, each a join by
set. Bitmaps are compared first, and only sets whose bitmaps allow a link are read and
travel. In a crowd of close copies that is hardly any; in one that is spread out, as many as
positions and sizes allow. Nothing is capped.

Defined results: words and case as for fingerprints; fewer words than a shingle
make one shingle of all; a text without words has the empty set, and empty sets
are equal; a very long text is hashed in one piece; sets, not keys, are what is
grouped, so rows that repeat a key with other texts are told apart; rows without a
key take no part; an empty table gives no groups; sets and shingles are compared
by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, store
from . import text as tx

SHINGLE = 5
#: Bytes of texts whose shingles are hashed at once, at about 65 bytes of memory each.
BLOCK = 1 << 18
#: Least similarity, as a fraction.
NUM, DEN = 4, 5
#: Texts that are sampled for widely shared shingles, and the most of these that are ordered last.
SAMPLE = 16_384
COMMON = 65_536
#: Counts of words, by hash, and the steps of a doubling in which frequencies are ordered.
SLOTS, STEPS = 1 << 16, 16
#: Indexed shingles that one task sorts, about.
TASK_ROWS = 2_000_000
#: Shingles of a candidate component that one task holds, at most, and pivots that a larger one has.
COMPONENT, PIVOTS = 1 << 23, 8
#: Sharers of a shingle that are compared pairwise; more are compared by size and position.
FEW = 64


def _slots(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(SLOTS - 1)).astype(np.int64)


def distinct(buf: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct shingle hashes of each text, and where each text's begin (one more than texts)."""
    return weighed(buf, offs, None, size)[:2]


def weighed(buf: np.ndarray, offs: np.ndarray, value: np.ndarray | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What ``distinct`` gives, the sum of each shingle's words' values by slot, and the hashes of all words."""
    buf = tx.LOWER[buf]
    starts, ends, rows = tx.words(buf, offs)
    texts = len(offs) - 1
    n = np.bincount(rows, minlength=texts)
    head = np.cumsum(n) - n
    k = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    of = np.repeat(np.arange(texts), k)
    i = np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k) + head[of]
    j = np.minimum(i + size, head[of] + n[of])
    words = tx.word_hashes(buf, starts, ends) if len(of) else np.zeros(0, np.uint64)
    h = tx.span_hashes(tx.prefix_sums(words), i, j) if len(of) else np.zeros(0, np.uint64)
    o = np.lexsort((h, of))
    h, of = h[o], of[o]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    sums = np.zeros(len(words) + 1, np.int64)
    if value is not None:
        np.cumsum(value[_slots(words)], out=sums[1:])
    o = o[new]
    return h[new], np.searchsorted(of[new], np.arange(texts + 1)), sums[j[o]] - sums[i[o]], words


def _names(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    return np.array([int.from_bytes(hashlib.blake2b(h[a:b].tobytes(), digest_size=8).digest(), "little", signed=True) for a, b in zip(cut.tolist(), cut[1:].tolist())], np.int64)


def _counted(size: int):
    def run(batches):
        for batch in batches:
            for _, buf, offs in tx.blocks(batch, "text", BLOCK):
                h, _, _, words = weighed(buf, offs, None, size)
                for kind, values in enumerate((tx.signed(h), _slots(words))):
                    x, c = tx.counted(values)
                    yield pa.record_batch({"word": np.full(len(x), kind, np.int32), "h": x, "c": c.astype(np.int64)})

    return run


def common(rows: DataFrame, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles that several sampled texts share, ascending, their weights, and the weights of words by slot.

    A weight is the logarithm of a count, in whole steps; that of a shingle that isn't listed is the
    logarithm of how often its words would meet by chance, the sum of their weights (see SLOTS).
    """
    step = max(1, rows.count() // SAMPLE)
    some = rows.where(F.pmod(F.xxhash64("doc_id", "th"), F.lit(step)) == 0).select("text")
    found = some.mapInArrow(_counted(size), "word int, h long, c long").groupBy("word", "h").agg(F.sum("c").alias("c"))
    found = store.written(found.where("word = 1 OR c >= 3"), "common")
    got = found.where("word = 0").orderBy(F.desc("c"), "h").limit(COMMON).select("h", "c").toArrow()
    h, c = got["h"].to_numpy().view(np.uint64), got["c"].to_numpy()
    o = np.argsort(h)
    got = found.where("word = 1").select("h", "c").toArrow()
    counts = np.ones(SLOTS)
    counts[got["h"].to_numpy()] = got["c"].to_numpy()
    steps = lambda x: np.rint(STEPS * np.log2(x)).astype(np.int64)
    # in a shingle of `size` words, size - 1 times the logarithm of all words makes frequencies of counts
    return h[o], steps(c[o]) + (size - 1) * steps(counts.sum()), steps(counts)


def _bitmaps(h: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the parity of each set's hashes by their low bits, in at least twice as many bits as hashes."""
    n = np.diff(cut)
    width = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(2 * n, 1)))).astype(np.int64)
    base = np.r_[0, np.cumsum(width)]
    at = np.repeat(base[:-1], n) + (h & np.repeat(width - 1, n).astype(np.uint64)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=int(base[-1])) & 1).astype(np.uint8), bitorder="little"), base // 8


def _differ(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ; the wider one is folded to the other's width."""
    if len(x) < len(y):
        x, y = y, x
    k, width, other = int.from_bytes(x, "little"), 8 * len(x), int.from_bytes(y, "little")
    while width > 8 * len(y):
        width //= 2
        k = (k >> width) ^ (k & ((1 << width) - 1))
    return (k ^ other).bit_count()


def _close(batches):
    """The pairs whose bitmaps allow enough similarity."""
    for batch in batches:
        n = batch.column("n").to_numpy().astype(np.int64) + batch.column("m").to_numpy()
        apart = np.array([_differ(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())], np.int64)
        yield batch.select(["a", "b"]).filter(pa.array((NUM + DEN) * (n - apart) >= 2 * NUM * n))


#: Columns of ``sketch``.
SKETCH = "node long, n int, prefix array<long>, bits binary"


def sketch(buf: np.ndarray, offs: np.ndarray, last: np.ndarray, weight: np.ndarray, value: np.ndarray, size: int = SHINGLE) -> dict:
    """Per text: the name of its set, its size, its first shingles in the common order and its bitmap."""
    h, cut, w, _ = weighed(buf, offs, value, size)
    n = np.diff(cut)
    of = np.repeat(np.arange(len(n)), n)
    if len(last):
        at = np.minimum(np.searchsorted(last, h), len(last) - 1)
        w = np.where(last[at] == h, np.maximum(weight[at], w), w)
    o = np.lexsort((h, w, of))
    first = np.where(n > 0, n - -(-NUM * n // DEN) + 1, 0)
    keep = np.arange(len(h)) - cut[of] < first[of]
    ends = np.r_[0, np.cumsum(first)].astype(np.int32)
    data, at = _bitmaps(h, cut)
    bits = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
    prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(tx.signed(h[o][keep])))
    return {"node": _names(h, cut), "n": n.astype(np.int32), "prefix": prefix, "bits": bits}


def _enough(overlap, n, m):
    """Whether sets of n and m with this overlap (or bound of it) are alike enough."""
    return (NUM + DEN) * overlap >= NUM * (n + m)


def _crowd(n: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """A group number for each sharer of one shingle, -1 if no other may be like it."""
    kinds, kind, count = np.unique(np.stack([n, rest], 1), axis=0, return_inverse=True, return_counts=True)
    kn, kr = kinds[:, 0], kinds[:, 1]
    group, left, name = np.full(len(kinds), -1), np.arange(len(kinds)), 0
    while len(left):
        queue, left, met = [left[0]], left[1:], [left[0]]
        while queue and len(left):
            at = queue.pop()
            near = _enough(1 + np.minimum(kr[at], kr[left]), kn[at], kn[left])
            queue.extend(left[near])
            met.extend(left[near])
            left = left[~near]
        if len(met) > 1 or count[met[0]] > 1 and _enough(1 + kr[met[0]], kn[met[0]], kn[met[0]]):
            group[met] = name
            name += 1
    return group[kind.reshape(-1)]


def _share(batches):
    """Of rows sorted by shingle: pairs (a, b) of sharers that may be alike, or for a crowd links that connect these."""

    def emit(h, node, n, rest):
        new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        k = np.diff(np.append(new, len(h)))
        out = [np.zeros((0, 3), np.int64)]
        for at, m in zip(new[k > FEW], k[k > FEW]):
            group, members = _crowd(n[at : at + m], rest[at : at + m]), node[at : at + m]
            o = np.flatnonzero(group >= 0)
            least = np.full(len(members), np.iinfo(np.int64).max)
            np.minimum.at(least, group[o], members[o])
            out.append(np.stack([members[o], least[group[o]], np.ones(len(o), np.int64)], 1))
        size = np.repeat(k, k)
        few = (size > 1) & (size <= FEW)
        h, node, n, rest = h[few], node[few], n[few], rest[few]
        for gap in range(1, min(FEW, len(h))):
            i = np.flatnonzero(h[gap:] == h[:-gap])
            if not len(i):
                break
            i = i[_enough(1 + np.minimum(rest[i], rest[i + gap]), n[i], n[i + gap])]
            out.append(np.stack([np.minimum(node[i], node[i + gap]), np.maximum(node[i], node[i + gap]), np.zeros(len(i), np.int64)], 1))
        out = np.concatenate(out)
        out = np.unique(out[out[:, 0] != out[:, 1]], axis=0)
        return pa.record_batch({"a": out[:, 0], "b": out[:, 1], "crowd": out[:, 2]})

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [batch.column(c).to_numpy().astype(np.int64) for c in ("h", "node", "n", "rest")]
        cut = int(np.searchsorted(now[0], now[0][-1]))
        if cut or held and held[-1][0][-1] != now[0][0]:
            yield emit(*(np.concatenate(x) for x in zip(*held, [y[:cut] for y in now])))
            held = []
        held.append([y[cut:] for y in now])
    if held:
        yield emit(*(np.concatenate(x) for x in zip(*held)))


def alike(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the number of the first set that verified links lead to."""
    n = np.array([len(x) for x in sets], np.int64)
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    code = np.split(flat, np.cumsum(n)[:-1])
    mark, out = np.zeros(len(names), bool), np.arange(len(sets))
    empty = np.flatnonzero(n == 0)
    out[empty] = empty[:1].repeat(len(empty))
    left = np.flatnonzero(n)
    while len(left) > 1:
        seed, left = left[0], left[1:]
        queue, flat = [seed], None
        while queue and len(left):
            at = queue.pop()
            if flat is None:
                flat, head = np.concatenate([code[i] for i in left]), np.cumsum(n[left]) - n[left]
            mark[code[at]] = True
            near = _enough(np.add.reduceat(mark[flat], head, dtype=np.int64), n[at], n[left])
            mark[code[at]] = False
            if near.any():
                out[left[near]] = seed
                queue.extend(left[near])
                left, flat = left[~near], None
    return out


def _verified(batches):
    """Of rows sorted by candidate component: (node, group), group being a node."""

    def emit(table):
        table = table.combine_chunks()
        comp, node = table["component"].to_numpy(), table["node"].to_numpy()
        new = np.flatnonzero(np.r_[True, comp[1:] != comp[:-1], True])
        lists = table["set"].chunk(0) if table["set"].num_chunks else pa.array([], pa.list_(pa.int64()))
        offs, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        nodes, groups = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(new.tolist(), new[1:].tolist()):
            mine, one = np.unique(node[a:b], return_index=True)
            group = alike([values[offs[a + i] : offs[a + i + 1]] for i in one.tolist()])
            nodes.append(mine)
            groups.append(mine[group])
        return pa.record_batch({"node": np.concatenate(nodes), "grp": np.concatenate(groups)})

    held, before = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        comp, node = batch.column("component").to_numpy(), batch.column("node").to_numpy()
        new = np.r_[before != (comp[0], node[0]), (comp[1:] != comp[:-1]) | (node[1:] != node[:-1])]
        before = comp[-1], node[-1]
        batch, comp = batch.filter(pa.array(new)), comp[new]  # equal rows come once
        if not batch.num_rows:
            continue
        cut = int(np.searchsorted(comp, comp[-1]))
        if held and held[-1].column("component")[0].as_py() != comp[0] or cut:
            yield emit(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield emit(pa.Table.from_batches(held))


def _sets(size: int):
    """The sets of candidates, of the rows that have the wanted one."""

    def run(batches):
        for batch in batches:
            for part, buf, offs in tx.blocks(batch, "text", BLOCK):
                h, cut = distinct(buf, offs, size)
                sets = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(tx.signed(h)))
                same = pa.array(_names(h, cut) == part.column("node").to_numpy())
                yield pa.record_batch({"component": part.column("component"), "node": part.column("node"), "set": sets}).filter(same)

    return run


def groups(sketches: DataFrame, rows: DataFrame, also: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(node, doc_id, th, grp): for each distinct set its least row and its group; equal ``grp``, near-copies.

    ``sketches``: (doc_id, th) and SKETCH of ``rows`` (doc_id, th, text), th being a hash of the
    text. ``also``: pairs of nodes that another source takes for candidates, verified like the rest.
    """
    spark = rows.sparkSession
    first = store.written(sketches.groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("f"), F.max("n").alias("n")).select("node", "f.*", "n"), "sets")
    own = sketches.join(first.drop("n"), ["node", "doc_id", "th"]).dropDuplicates(["node"])
    own = store.written(own.select("node", "n", "prefix", "bits"), "own")
    index = own.select("node", "n", F.posexplode("prefix").alias("at", "h")).select("h", "node", "n", (F.col("n") - F.col("at") - 1).alias("rest"))
    size_of = own.agg(F.sum(F.size("prefix"))).first()[0] or 0
    dealt = index.repartition(store.partitions(spark, size_of, TASK_ROWS), "h").sortWithinPartitions("h")
    met = store.written(dealt.mapInArrow(_share, "a long, b long, crowd long").distinct(), "sharers")
    near = _near(met.where("crowd = 0"), own, "close")
    links = near.union(met.where("crowd = 1").select("a", "b"))
    parts = components.connected(links.union(also), "candidates").toDF("node", "component")
    wanted = store.written(parts.join(first, "node"), "wanted")
    large = store.written(wanted.groupBy("component").agg(F.sum("n").alias("n")).where(F.col("n") > COMPONENT).select("component"), "large")
    small = wanted.join(large, "component", "left_anti")
    task = store.partitions(spark, small.agg(F.sum("n")).first()[0] or 0, 4 * TASK_ROWS)
    of = lambda some: rows.join(some.select("doc_id", "th", "component", "node"), ["doc_id", "th"]).mapInArrow(_sets(size), "component long, node long, set array<long>")
    found = of(small).repartition(task, "component").sortWithinPartitions("component", "node").mapInArrow(_verified, "node long, grp long")
    found = store.written(found, "verified")
    if not large.isEmpty():
        some = wanted.join(large, "component", "left_semi")
        fetch = lambda nodes: of(some.join(nodes, "node", "left_semi")).dropDuplicates(["node"]).select("node", "set")
        found = found.union(_in_pairs(store.written(some.select("component", "node"), "some"), own, index, near.union(also.toDF("a", "b")), fetch))
    return first.join(found, "node", "left").select("node", "doc_id", "th", F.coalesce("grp", "node").alias("grp"))


def _alike(x: str, y: str):
    return _enough(F.size(F.array_intersect(x, y)), F.size(x), F.size(y))


def _near(pairs: DataFrame, own: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) whose bitmaps allow enough similarity."""
    pairs = pairs.join(own.select(F.col("node").alias("a"), "n", F.col("bits").alias("x")), "a")
    pairs = pairs.join(own.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y")), "b")
    return store.written(pairs.select("a", "b", "n", "m", "x", "y").mapInArrow(_close, "a long, b long"), name)


def _real(pairs: DataFrame, fetch) -> DataFrame:
    """The pairs (a, b) whose sets, as ``fetch`` reads them for nodes, are alike."""
    ends = store.written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "ends")
    sets = store.written(fetch(ends), "sets")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    real = store.written(both.where(_alike("x", "y")).select("a", "b"), "real")
    store.drop(pairs.sparkSession, sets)
    return real


def _in_pairs(members: DataFrame, own: DataFrame, index: DataFrame, pairs: DataFrame, fetch) -> DataFrame:
    """(node, grp) of components that are too large for one task; members: (component, node), own: (node, n, bits), index: (h, node, n, rest), pairs: (a, b)."""
    mine = store.written(members.join(own.select("node", "n", "bits"), "node"), "bits")
    state = store.written(members.select("component", "node", F.lit(None).cast("long").alias("pivot")), "state")
    for _ in range(PIVOTS):
        # by bitmaps; the sets are compared once all have their pivots
        chosen = state.where("pivot IS NULL").groupBy("component").agg(F.min("node").alias("node"))
        pivots = mine.join(chosen, ["component", "node"]).select("component", F.col("node").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"))
        open_ = mine.join(state.where("pivot IS NULL").select("node"), "node", "left_semi").select("component", F.col("node").alias("a"), "n", F.col("bits").alias("x"))
        hits = open_.join(pivots, "component").select("a", "b", "n", "m", "x", "y").mapInArrow(_close, "a long, b long").toDF("node", "p")
        state = store.written(state.join(hits, "node", "left").select("component", "node", F.coalesce("pivot", "p").alias("pivot")), "state")
        if state.where("pivot IS NULL").isEmpty():
            break
    real = _real(state.where("pivot <> node").select(F.col("node").alias("a"), F.col("pivot").alias("b")), fetch)
    state = store.written(members.join(real.toDF("node", "pivot"), "node", "left").select("component", "node", "pivot"), "state")
    label = state.select("node", F.coalesce("pivot", "node").alias("label"))
    end = lambda c: label.toDF(c, f"l{c}")
    told = pairs.join(end("a"), "a").join(end("b"), "b").where("la <> lb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # sharers of a crowded shingle, of different groups only
    crowded = index.groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") > FEW).select("h")
    held = store.written(index.join(label, "node").join(crowded, "h", "left_semi"), "held")
    mixed = held.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("h")
    left = held.join(mixed, "h", "left_semi")
    right = left.toDF(*(f"{c}_" for c in left.columns))
    close = _enough(1 + F.least("rest", "rest_"), F.col("n"), F.col("n_"))
    met = left.join(right, (F.col("h") == F.col("h_")) & (F.col("label") < F.col("label_")) & close)
    every = told.union(met.select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b"))).distinct()
    real = _real(_near(every, own, "closer"), fetch).union(real)
    grp = components.connected(real, "large").toDF("node", "grp")
    return state.select("node").join(grp, "node", "left").select("node", F.coalesce("grp", "node").alias("grp"))

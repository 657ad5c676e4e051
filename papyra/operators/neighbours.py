"""Exact neighbours by cosine or distance, in tiles: rows are dealt out once, then no vector is shuffled.

Rows are met where they are read by chunks of all rows that are broadcast one at a
time, each of a bounded number of bytes. A row carries what it has found from chunk to
chunk, so a task holds one chunk, one batch and one tile of pairs, whatever the number of
rows. All pairs are compared, in single precision first, which is quadratic by nature;
pairs that single precision can't decide are computed again in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra import store

#: Bytes of vectors in one broadcast; rows and pairs of a tile; pairs computed again at once; rows of a task.
CHUNK_BYTES, BLOCK, TILE, AGAIN, PER_TASK = 16 << 20, 512, 1 << 20, 1 << 15, 1 << 16


def rows(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) with double components, written once and dealt evenly: a task's work is its rows times all rows."""
    spark = vectors.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-vectors.count() // PER_TASK))
    return store.written(vectors.select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v")).repartition(parts), "vectors")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in chunks if len(c)]
    n = sum(len(c) for c in chunks)
    return np.concatenate(flat).reshape(n, -1) if flat else np.zeros((0, 0))


def lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())


def chunks(data: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of all rows in chunks that a hash of the id decides."""
    n, most = data.agg(F.count("*"), F.max(F.size("v"))).first()
    parts = max(1, -(-n * 8 * (most or 1) // CHUNK_BYTES))
    for c in range(parts):
        some = data.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == c).orderBy("id").toArrow()
        yield some["id"].to_numpy(), matrix(some["v"])


def meet(begun: DataFrame, data: DataFrame, look: Callable, schema: str) -> Iterator[DataFrame]:
    """``look(batches, ids, q)`` of ``begun`` and the first chunk of ``data``, as a written table; then of that table and the next chunk."""
    for ids, q in chunks(data):
        shared = data.sparkSession.sparkContext.broadcast((ids, q))

        def run(batches, shared=shared):
            yield from look(batches, *shared.value)

        done, begun = begun, store.written(begun.mapInArrow(run, schema), "met")
        shared.unpersist()
        yield begun
        if "met" in done.columns:
            store.drop(data.sparkSession, done)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _slack(dims: int) -> float:
    """More than the error of a product of two vectors in single precision, for unit lengths."""
    return (dims + 8) * 2.4e-7


def _products(p: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """p[i] * q[j], summed in one order, so that equal vectors give equal products."""
    out = np.empty(len(i))
    for at in range(0, len(i), AGAIN):
        some = slice(at, at + AGAIN)
        out[some] = np.einsum("ij,ij->i", p[i[some]], q[j[some]])
    return out


def nearest(own: np.ndarray, p: np.ndarray, ids: np.ndarray, q: np.ndarray, best: np.ndarray, names: np.ndarray, single: np.ndarray) -> None:
    """Better entries of ``q`` than those of ``best`` and ``names`` replace them, for all rows of ``p``; vectors of unit length.

    ``single`` is ``q`` in single precision. Similarities are told apart to twelve digits, ties to smaller ids.
    """
    k, slack = best.shape[1], _slack(p.shape[1])
    for top in range(0, len(p), BLOCK):
        block = slice(top, top + BLOCK)
        x, me, b, n = p[block], own[block], best[block], names[block]
        x32, wide = x.astype(np.float32), max(k, TILE // len(x))
        for at in range(0, len(q), wide):
            s = x32 @ single[at : at + wide].T
            least = b[:, -1]
            if s.shape[1] > k and np.isneginf(least).any():
                # nothing below the k-th of this tile comes among the best
                s[me[:, None] == ids[None, at : at + wide]] = -np.inf
                least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k].astype(float) - slack)
            i, j = np.nonzero(s >= (least - slack)[:, None].astype(np.float32))
            j += at
            other = me[i] != ids[j]
            i, j = i[other], j[other]
            found = np.round(_products(x, q, i, j), 12)
            some = (found > b[i, -1]) | ((found == b[i, -1]) & (ids[j] < n[i, -1]))
            if not some.any():
                continue
            i, found, got = i[some], found[some], ids[j[some]]
            at_row, line = np.unique(i, return_inverse=True)
            r = np.concatenate([np.repeat(np.arange(len(at_row)), k), line])
            all_s, all_n = np.concatenate([b[at_row].ravel(), found]), np.concatenate([n[at_row].ravel(), got])
            order = np.lexsort((all_n, -all_s, r))
            start = np.searchsorted(r[order], np.arange(len(at_row)))
            keep = order[start[:, None] + np.arange(k)]
            b[at_row], n[at_row] = all_s[keep], all_n[keep]


def knn(vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, similarity) of every row's k nearest others; ties to smaller ids.

    Vectors are made unit length; similarities are told apart to twelve digits.
    """

    def look(batches, ids, q):
        q = _unit(q)
        single = q.astype(np.float32)
        for batch in batches:
            own = batch.column("id").to_numpy()
            if not len(own):
                continue
            if "met" in batch.schema.names:
                best, names = matrix(batch.column("s")).copy(), matrix(batch.column("met")).copy()
            else:
                best, names = np.full((len(own), k), -np.inf), np.zeros((len(own), k), np.int64)
            nearest(own, _unit(matrix(batch.column("v"))), ids, q, best, names, single)
            yield pa.record_batch({"id": batch.column("id"), "v": batch.column("v"), "met": lists(names), "s": lists(best)})

    data = rows(vectors, key, vector)
    for met in meet(data, data, look, "id long, v array<double>, met array<long>, s array<double>"):
        pass
    each = met.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip((F.transform("s", lambda x: -x)).alias("d"), F.col("met").alias("vec_id"))).alias("n")).where("n.d < double('infinity')")
    line = F.slice(F.sort_array(F.collect_list("n")), 1, k)
    top = each.groupBy("query_id").agg(line.alias("n")).select("query_id", F.posexplode("n"))
    return top.select("query_id", (F.col("pos") + 1).alias("rank"), "col.vec_id", (-F.col("col.d")).alias("similarity"))


def near(p: np.ndarray, q: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of the pairs whose distance is ``radius`` or less, tile by tile."""
    if not len(p) or not len(q) or radius < 0:
        return
    pp, qq, q32 = (p * p).sum(1), (q * q).sum(1), q.astype(np.float32)
    # 2 p q >= pp + qq - radius^2, in halves that lie on either side
    right = ((qq - radius * radius) / 2).astype(np.float32)
    far = max(abs(float(radius)), 1.0) ** 2
    long = float(np.sqrt(qq.max()))
    for top in range(0, len(p), BLOCK):
        x, half = p[top : top + BLOCK], pp[top : top + BLOCK] / 2
        x32, wide = x.astype(np.float32), TILE // len(x)
        slack = np.float32(_slack(p.shape[1]) * (far + (float(np.sqrt(2 * half.max())) + long) ** 2))
        for at in range(0, len(q), wide):
            s = x32 @ q32[at : at + wide].T
            s -= right[at : at + wide]
            s -= half.astype(np.float32)[:, None]
            # what single precision can't hold is neither below nor above
            i, j = np.nonzero(~(s < -slack))
            unsure = np.flatnonzero(~(s[i, j] > slack))
            keep = np.ones(len(i), bool)
            keep[unsure] = distances(x, q[at : at + wide], i[unsure], j[unsure]) <= radius
            yield i[keep] + top, j[keep] + at


def distances(p: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    squares = (p * p).sum(1)[i] + (q * q).sum(1)[j] - 2 * _products(p, q, i, j)
    return np.sqrt(np.maximum(squares, 0))


def crowded(data: DataFrame, radius: float, few: int) -> DataFrame:
    """``data`` (id, v) with n, the number of others within ``radius``; where n is ``few`` or less, met and d name them (0 and infinity fill up)."""
    width = max(few, 1)

    def look(batches, ids, q):
        for batch in batches:
            own, p = batch.column("id").to_numpy(), matrix(batch.column("v"))
            if not len(own):
                continue
            if "met" in batch.schema.names:
                n, met, d = batch.column("n").to_numpy().copy(), matrix(batch.column("met")).copy(), matrix(batch.column("d")).copy()
            else:
                n, met, d = np.zeros(len(own), np.int64), np.zeros((len(own), width), np.int64), np.full((len(own), width), np.inf)
            for i, j in near(p, q, radius):
                other = own[i] != ids[j]
                i, j = i[other], j[other]
                place = n[i] + np.arange(len(i)) - np.searchsorted(i, i)  # nonzero gives rows in order
                n += np.bincount(i, minlength=len(n))
                some = place < width
                i, j, place = i[some], j[some], place[some]
                met[i, place], d[i, place] = ids[j], distances(p, q, i, j)
            yield pa.record_batch({"id": batch.column("id"), "v": batch.column("v"), "n": n, "met": lists(met), "d": lists(d)})

    for met in meet(data, data, look, "id long, v array<double>, n long, met array<long>, d array<double>"):
        pass
    return met


def joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of the groups of a and b, which ``parent`` names by their least members."""
    a, b = parent[a], parent[b]
    while True:
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]
        a, b = parent[a], parent[b]


def links(data: DataFrame, radius: float) -> DataFrame:
    """(a, b): links within ``radius`` that join the same rows of ``data`` (id, v) as all such links do.

    A task gives a link a row and chunk at most, and one for each of the chunk's rows.
    """

    def look(batches, ids, q):
        parent = np.arange(len(ids))
        for batch in batches:
            own, p = batch.column("id").to_numpy(), matrix(batch.column("v"))
            first = np.full(len(own), -1)
            for i, j in near(p, q, radius):
                new = first[i] < 0
                first[i[new]] = j[new]  # any of a row's will do, all are joined to it
                joined(parent, first[i], j)
            some = first >= 0
            yield pa.record_batch({"a": own[some], "b": ids[first[some]]})
        at = np.flatnonzero(parent != np.arange(len(ids)))
        yield pa.record_batch({"a": ids[at], "b": ids[parent[at]]})

    out = None
    for ids, q in chunks(data):
        shared = data.sparkSession.sparkContext.broadcast((ids, q))

        def run(batches, shared=shared):
            yield from look(batches, *shared.value)

        found = store.written(data.mapInArrow(run, "a long, b long").where("a <> b"), "links")
        shared.unpersist()
        out = found if out is None else out.union(found)
    return out

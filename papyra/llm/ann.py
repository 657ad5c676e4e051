"""Approximate nearest neighbours by multi-index hashing over learned binary codes.

Codes: vectors (with one more coordinate that makes all lengths equal, so that
inner products order like angles) are centred, rotated by PCA directions whose
rotation is then learned to lose least when signs are taken (iterative
quantisation), once per bank of bits. The fit and the Hamming radius come from a
bounded sample: the radius holds nearly all of the sample's true neighbours.

Index: a code is cut into SUBSTRINGS bytes, each with a table of its own. Within
the radius R of a query at least one substring differs by at most R // SUBSTRINGS
bits, so looking up all substring values that near finds every code within R.
Found codes are checked for R and their vectors reranked in double precision. A
query with too few codes in its radius is compared with all rows of the block.

All rows are indexed, in blocks that stay where they are read; the query set meets
them in chunks of CHUNK_BYTES, each broadcast by itself, so vectors are neither
shuffled nor copied. A task keeps the best K of every query of the chunk and emits
these only. Queries times rows is quadratic in a growing table; lookup saves the
reranking of what lies outside the radius.

Defined results: vectors that are null, zero, or hold null or non-finite components
take no part; vectors of different lengths are no candidates of each other, and each
length has codes of its own; components are scaled by the largest for the codes, so
any finite ones do, and products that overflow rank as infinite, those without a value
last; ties go to the smaller id; of rows that repeat an id the least vector counts, and
equal vectors of several ids are all candidates; null ids take no part; an empty table
gives no rows; other columns, whatever their names, are not carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

K = 20
#: A multiple of 8; each byte is a substring of its own.
CODE_BITS = 128
SUBSTRINGS = CODE_BITS // 8
#: Rows that the rotation, and queries of them that the radius, is fitted on, about.
SAMPLE, SAMPLE_QUERIES = 8192, 256
COVER = 0.985
ROUNDS = 20
BLOCK_ROWS = 16384
#: Bytes of query vectors in one broadcast.
CHUNK_BYTES = 16 << 20

_NEAR = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


class Codes:
    def __init__(self, sample: np.ndarray, longest: float, rng: np.random.Generator):
        self.longest = longest
        x = self.lift(sample)
        self.mean = x.mean(0)
        x = x - self.mean
        d = x.shape[1]
        vectors = np.linalg.eigh(x.T @ x / max(len(x), 1))[1][:, ::-1]
        banks, left = [], CODE_BITS
        while left:
            bits = min(d, left)
            basis = (vectors if not banks else np.linalg.qr(rng.normal(size=(d, d)))[0])[:, :bits]
            v = x @ basis
            r = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
            for _ in range(ROUNDS):
                u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
                r = (u @ w).T
            banks.append(basis @ r)
            left -= bits
        self.turn = np.concatenate(banks, 1)
        code = self.encode(sample)
        q = rng.permutation(len(sample))[:SAMPLE_QUERIES]
        s = sample[q] @ sample.T
        s[np.arange(len(q)), q] = -np.inf
        k = min(K, len(sample) - 1)
        near = np.argpartition(-s, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(q), 0), int)
        far = distance(code[q][:, None], code[near]) if near.size else np.array([CODE_BITS])
        self.radius = int(np.quantile(far, COVER))

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0.0))
        return np.concatenate([x, rest[:, None]], 1) / self.longest

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((self.lift(x) - self.mean) @ self.turn > 0, axis=1)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = np.ascontiguousarray(a ^ b)
    return np.bitwise_count(x.view(np.uint64)).sum(-1, dtype=np.int32)


class Tables:
    """A table per substring: rows by value."""

    def __init__(self, code: np.ndarray):
        self.code = code
        self.rows = [np.argsort(code[:, j], kind="stable").astype(np.int32) for j in range(SUBSTRINGS)]
        self.ptr = [np.searchsorted(code[r, j], np.arange(257)) for j, r in enumerate(self.rows)]

    def within(self, q: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose codes lie within the radius of code ``q``."""
        mark = np.zeros(len(self.code), bool)
        for j in range(SUBSTRINGS):
            values = np.flatnonzero(_NEAR[q[j]] <= radius // SUBSTRINGS)
            first, n = self.ptr[j][values], self.ptr[j][values + 1] - self.ptr[j][values]
            at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            mark[self.rows[j][at]] = True
        found = np.flatnonzero(mark)
        return found[distance(self.code[found], q) <= radius]


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in chunks]
    return np.concatenate([np.zeros(0), *flat]).astype(np.float64).reshape(-1, dim)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to smaller ids; scores without a value are least."""
    score = np.where(np.isnan(score), -np.inf, score)
    if len(score) > 4 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= cut)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:k]


class Best:
    """The k best candidates of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.n = k, np.zeros(n, np.int64)
        self.score, self.ids = np.zeros((n, k)), np.zeros((n, k), np.int64)

    def add(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        have = self.n[i]
        score, ids = np.r_[self.score[i, :have], score], np.r_[self.ids[i, :have], ids]
        top = best(score, ids, self.k)
        self.n[i] = len(top)
        self.score[i, : len(top)], self.ids[i, : len(top)] = score[top], ids[top]


def _search(shared, dim: int, k: int, block_rows: int):
    def look(found: Best, codes: Codes, scale: float, x: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, qcode: np.ndarray) -> None:
        tables = Tables(codes.encode(x / scale))
        for i in range(len(q)):
            near = tables.within(qcode[i], codes.radius)
            near = near[ids[near] != qids[i]]
            if len(near) < k:
                near = np.flatnonzero(ids != qids[i])
            with np.errstate(over="ignore", invalid="ignore"):
                s = (x[near] * q[i]).sum(1)
            top = best(s, ids[near], k)
            found.add(i, s[top], ids[near][top])

    def run(batches):
        codes, scale, q, qids = shared.value
        found, qcode = Best(len(q), k), codes.encode(q / scale)
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, block_rows - n)
                held.append((_matrix(part.column("v"), dim), part.column("id").to_numpy()))
                at, n = at + part.num_rows, n + part.num_rows
                if n == block_rows:
                    look(found, codes, scale, *(np.concatenate(c) for c in zip(*held)), q, qids, qcode)
                    held, n = [], 0
        if held:
            look(found, codes, scale, *(np.concatenate(c) for c in zip(*held)), q, qids, qcode)
        some = np.arange(k)[None, :] < found.n[:, None]
        yield pa.record_batch({"query_id": np.repeat(qids, found.n), "vec_id": found.ids[some], "score": found.score[some]})

    return run


def _of_length(real: DataFrame, dim: int, n: int, every: int, k: int, block_rows: int) -> DataFrame:
    """(query_id, vec_id, score) of the candidates, among ``n`` vectors of one length."""
    spark = real.sparkSession
    scale = float(real.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()[0])
    sum2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / scale) * (x / scale))
    longest = float(real.agg(F.sqrt(F.max(sum2))).first()[0])
    drawn = F.pmod(F.xxhash64("id", F.lit("codes")), F.lit(1 << 30)) < int(min(1.0, SAMPLE / n) * (1 << 30))
    sample = _matrix(real.where(drawn).orderBy("id").select("v").toArrow()["v"], dim)
    if len(sample) < 2:
        sample = _matrix(real.orderBy("id").limit(SAMPLE).select("v").toArrow()["v"], dim)
    codes = Codes(sample / scale, longest, np.random.default_rng(0))
    queries = real.where(F.pmod("id", F.lit(every)) == 0)
    chunks = -(-max(1, queries.count()) * 8 * dim // CHUNK_BYTES)
    out = None
    for c in range(chunks):
        asked = queries.where(F.pmod(F.xxhash64("id", F.lit("q")), F.lit(chunks)) == c).orderBy("id").toArrow()
        shared = spark.sparkContext.broadcast((codes, scale, _matrix(asked["v"], dim), asked["id"].to_numpy()))
        found = real.select("id", "v").mapInArrow(_search(shared, dim, k, block_rows), "query_id long, vec_id long, score double")
        if chunks > 1:
            found = store.written(found, "found")
            shared.unpersist()
        out = found if out is None else out.union(found)
    return out


def search(vectors: DataFrame, every: int = 20, k: int = K, key: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, its k nearest by inner product."""
    spark = vectors.sparkSession
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    real = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), v.alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    real = real.where(F.forall("v", finite) & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))
    real = store.written(real, "vectors")
    again = store.written(real.groupBy("id").count().where("count > 1").select("id"), "again")
    if not again.isEmpty():
        least = real.join(again, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
        real = store.written(real.join(again, "id", "left_anti").union(least), "vectors")
    lengths = real.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect()
    found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    for r in lengths:
        found = found.union(_of_length(real.where(F.col("dim") == r.dim), r.dim, r.n, every, k, block_rows))
    # a score without a value is last
    down = F.when(F.isnan("score"), float("inf")).otherwise(-F.col("score")).alias("d")
    line = F.sort_array(F.collect_list(F.struct(down, "vec_id", "score")))
    top = found.groupBy("query_id").agg(F.slice(line, 1, k).alias("top")).select("query_id", F.posexplode("top"))
    return top.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("col.vec_id").alias("vec_id"), F.col("col.score").alias("score"))

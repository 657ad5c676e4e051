"""SimHash near-duplicates through deletion-variant signatures.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word
shingles. Fingerprints at most two bits apart are linked: of the two halves, one
differs by at most one bit, so each fingerprint is indexed under the 64 signatures
"half with one bit deleted". Equal signatures meet and are verified.

Copies collapse first (one row per fingerprint). A signature shared by more than
CROWD fingerprints is not paired up: its members get the two-bit deletion
signatures instead. All that share one of these lie within two bits of each other, so
linking each to the next loses nothing, and work is linear in every group's size.
Nothing is capped.

Defined results: a text that is null or has no word has fingerprint zero and is
linked like any other; fewer words than a shingle make one shingle of all; a very
long text is hashed in one piece, at about 60 bytes a word; rows that repeat a key
are all returned, a null key has component null and links nothing; an empty table
gives no rows; other input columns, whatever their names, are not carried along
(``one_of_each`` returns the columns of its input and no others).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, shingles, store
from . import text as tx
from .xxh import hash_spans

SHINGLE = 3
DISTANCE = 2
#: Signatures that one task sorts, about.
TASK_ROWS = 2_000_000
#: Fingerprints of one signature that are compared pairwise; larger ones take the two-bit signatures.
CROWD = 256

_LANES = np.uint64(0x0101010101010101)


def majority(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bits set in over half of each run of hashes; runs begin at ``first``."""
    n = np.diff(np.append(first, len(h)))
    # runs are cut into pieces of at most 255 hashes, whose counts fit a byte lane
    pieces = (n + 254) // 255
    run = np.repeat(np.arange(len(first)), pieces)
    begin = first[run] + 255 * (np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    head = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    out = np.zeros(len(first), np.uint64)
    for b in range(8):
        lanes = np.add.reduceat((h >> np.uint64(b)) & _LANES, begin)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), head, axis=0)
        over = 2 * counts > n[:, None]
        for k in range(8):
            out |= over[:, k].astype(np.uint64) << np.uint64(8 * k + b)
    return out


def prints(buf: np.ndarray, offs: np.ndarray, size: int) -> np.ndarray:
    """The fingerprint of each text of a block."""
    buf = tx.LOWER[buf]
    texts = len(offs) - 1
    starts, ends, rows = tx.words(buf, offs)
    # words joined by one blank
    width = ends - starts + 1
    at = np.cumsum(width) - width
    flat = np.full(int(width.sum()), 32, np.uint8)
    flat[np.arange(len(flat)) - np.repeat(at - starts, width) < np.repeat(ends, width)] = buf[~tx.SPACE[buf]]
    n = np.bincount(rows, minlength=texts)
    head = np.cumsum(n) - n
    k = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    of = np.repeat(np.arange(texts), k)
    i = np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k) + head[of]
    j = np.minimum(i + size, head[of] + n[of]) - 1
    h = hash_spans(flat, at[i], at[j] + width[j] - 1)
    fp = np.zeros(texts, np.uint64)
    some = np.flatnonzero(k)
    if len(some):
        fp[some] = majority(h, (np.cumsum(k) - k)[some])
    return fp


def _prints(size: int):
    def run(batches):
        for batch in batches:
            for part, buf, offs in tx.blocks(batch, "text"):
                yield pa.record_batch({"doc_id": part.column("doc_id"), "fp": prints(buf, offs, size).view(np.int64)})

    return run


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long); the bits of fp are the unsigned fingerprint."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(_prints(shingle), "doc_id long, fp long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _drop_bit(half: np.ndarray, at: int) -> np.ndarray:
    low = np.uint64((1 << at) - 1)
    return (half & low) | ((half >> np.uint64(1)) & ~low)


#: (first bit, width) of the halves.
HALVES = ((0, 32), (32, 32))


def _signatures(batches):
    """64 rows per fingerprint: signature = deleted bit (6), the rest of its half (31)."""
    for batch in batches:
        fp = batch.column("fp").to_numpy().view(np.uint64)
        for lo, width in HALVES:
            part = (fp >> np.uint64(lo)) & np.uint64((1 << width) - 1)
            for at in range(width):
                sig = np.uint64((lo + at) << 31) | _drop_bit(part, at)
                yield pa.record_batch({"sig": sig.view(np.int64), "fp": batch.column("fp")})


def _pairs(x: np.ndarray, y: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Which candidate pairs are links that this signature, of all that they share, reports."""
    diff = x ^ y
    first = np.full(len(diff), 64, np.int64)
    for lo, width in reversed(HALVES):
        bits = (diff >> np.uint64(lo)) & np.uint64((1 << width) - 1)
        at = np.where(bits == 0, 0, _popcount((bits & (~bits + np.uint64(1))) - np.uint64(1)))
        first = np.where(_popcount(bits) <= 1, lo + at, first)
    return ((sig >> np.uint64(31)).astype(np.int64) == first) & (_popcount(diff) <= DISTANCE)


def _meet(batches):
    """Of rows sorted by signature: verified links, and the members of crowded signatures (b null)."""

    def emit(sig, fp):
        new = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        n = np.diff(np.append(new, len(sig)))
        size = np.repeat(n, n)
        members = fp[size > CROWD]
        few = (size > 1) & (size <= CROWD)
        sig, fp = sig[few], fp[few]
        out = [np.zeros((0, 2), np.uint64)]
        for gap in range(1, min(CROWD, len(sig))):
            i = np.flatnonzero(sig[gap:] == sig[:-gap])  # neighbours `gap` apart in a run
            if not len(i):
                break
            real = _pairs(fp[i], fp[i + gap], sig[i])
            out.append(np.stack([fp[i][real], fp[i + gap][real]], 1))
        pairs = np.concatenate(out)
        a = np.concatenate([pairs[:, 0], members]).view(np.int64)
        b = np.concatenate([pairs[:, 1], members]).view(np.int64)
        return pa.record_batch({"a": a, "b": pa.array(b, mask=np.arange(len(b)) >= len(pairs))})

    sig, fp = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    for batch in batches:
        sig = np.concatenate([sig, batch.column("sig").to_numpy().view(np.uint64)])
        fp = np.concatenate([fp, batch.column("fp").to_numpy().view(np.uint64)])
        if not len(sig):
            continue
        cut = int(np.searchsorted(sig.view(np.int64), sig.view(np.int64)[-1]))
        if cut:
            yield emit(sig[:cut], fp[:cut])
            sig, fp = sig[cut:], fp[cut:]
        if len(sig) > 200_000:  # one long run: all but a crowd's worth are members already
            yield pa.record_batch({"a": fp[CROWD + 1 :].view(np.int64), "b": pa.nulls(len(fp) - CROWD - 1, pa.int64())})
            sig, fp = sig[: CROWD + 1], fp[: CROWD + 1]
    if len(sig):
        yield emit(sig, fp)


def _two_bit(batches):
    """All 2016 two-bit deletions of each fingerprint."""
    ones = [np.uint64(1 << i) for i in range(64)]
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            fp = batch.slice(start, 4096).column("fp").to_numpy().view(np.uint64)
            for i in range(63):
                left = np.concatenate([fp & ~(ones[i] | ones[j]) for j in range(i + 1, 64)])
                at = np.repeat(np.arange(i * 64 + i + 1, i * 64 + 64, dtype=np.int32), len(fp))
                yield pa.record_batch({"sig": left.view(np.int64), "at": at, "fp": np.tile(fp, 63 - i).view(np.int64)})


def _chain(batches):
    """Of rows sorted by two-bit signature: each fingerprint and the next of its signature."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, at, fp = (batch.column(c).to_numpy() for c in ("sig", "at", "fp"))
        if last is not None:
            sig, at, fp = (np.r_[x, y] for x, y in zip(last, (sig, at, fp)))
        last = sig[-1:], at[-1:], fp[-1:]
        i = np.flatnonzero((sig[1:] == sig[:-1]) & (at[1:] == at[:-1]) & (fp[1:] != fp[:-1]))
        yield pa.record_batch({"a": fp[i], "b": fp[i + 1]})


def links(distinct: DataFrame, rows: int) -> DataFrame:
    """(a, b) links between ``rows`` distinct fingerprints ``fp`` that connect all within two bits."""
    n = store.partitions(distinct.sparkSession, 64 * rows, TASK_ROWS)
    sigs = distinct.select("fp").mapInArrow(_signatures, "sig long, fp long")
    met = store.written(sigs.repartition(n, "sig").sortWithinPartitions("sig").mapInArrow(_meet, "a long, b long"), "met")
    crowded = store.written(met.where("b is null").select(F.col("a").alias("fp")).distinct(), "crowded")
    keys = crowded.mapInArrow(_two_bit, "sig long, at int, fp long")
    n = store.partitions(distinct.sparkSession, 2016 * crowded.count(), TASK_ROWS)
    chains = keys.repartition(n, "sig").sortWithinPartitions("sig", "at", "fp").mapInArrow(_chain, "a long, b long")
    return met.where("b is not null").union(chains)


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    every = store.written(fingerprints(docs, text, key, shingle), "prints")
    first = store.written(every.groupBy("fp").agg(F.min("doc_id").alias("least")).where("least is not null"), "first")
    found = links(first, first.count())
    ends = found.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    groups = components.connected(ends, "near")
    of = first.join(groups, first["least"] == groups["node"], "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    name = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return every.join(of, "fp", "left").select("doc_id", name, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def _sketches(size: int, last: np.ndarray, weight: np.ndarray, value: np.ndarray):
    """Fingerprint and shingle sketch of each text, in one pass."""

    def run(batches):
        for batch in batches:
            for part, buf, offs in tx.blocks(batch, "text", shingles.BLOCK):
                fp = prints(buf, offs, size).view(np.int64)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "th": part.column("th"), "fp": fp, **shingles.sketch(buf, offs, last, weight, value)})

    return run


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without near-duplicates: of each group the row of the smallest key stays, once; rows without a key stay.

    Candidates are the texts whose fingerprints are linked, and those that the exact
    prefix filter of ``shingles`` finds; every link is verified by five-word Jaccard
    similarity. Rows are told apart by key and text, so rows that repeat a key stay
    as long as their texts are no near-copies of a smaller row's; of equal rows one
    stays.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    ident = F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("th")
    rows = docs.where(F.col(key).isNotNull()).select(*ident, F.col(text).cast("binary").alias("text"))
    sketches = rows.mapInArrow(_sketches(SHINGLE, *shingles.common(rows)), f"doc_id long, th long, fp long, {shingles.SKETCH}")
    sketches = store.written(sketches, "sketches")
    fps = store.written(sketches.groupBy("fp").agg(F.min("node").alias("node")), "fps")
    found = links(fps, fps.count()).join(fps.toDF("a", "x"), "a").join(fps.toDF("b", "y"), "b").select("x", "y")
    alike = sketches.select("fp", "node").distinct().join(fps.toDF("fp", "y"), "fp").where("node <> y").select("node", "y")
    groups = shingles.groups(sketches, rows, found.union(alike))
    stay = groups.groupBy("grp").agg(F.min(F.struct("doc_id", "th")).alias("s")).select("s.*")
    marked = docs.select(*(F.col(c).alias(n) for c, n in zip(docs.columns, names)), *ident)
    kept = marked.join(stay, ["doc_id", "th"], "left_semi")
    again = store.written(sketches.groupBy("doc_id", "th").count().where("count > 1").select("doc_id", "th"), "again")
    if not again.isEmpty():  # equal rows: one of them
        once = kept.join(again, ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"])
        kept = kept.join(again, ["doc_id", "th"], "left_anti").union(once.select(*kept.columns))
    return kept.union(marked.where("doc_id IS NULL").select(*kept.columns)).select(*names).toDF(*docs.columns)

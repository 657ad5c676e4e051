"""Substring dedup by automata of repeated phrases: passages of WINDOW words that begin in an earlier document too are removed.

1. Survey: of every WINDOW consecutive words, the phrase of PHRASE words with the
   least hash is an anchor, so equal windows have an equal anchor. Anchors in two
   documents or more are *confirmed* recurring passages; their words are taken from
   the least of these documents.
2. Documents are dealt to shards by a hash of key and text. A shard gets every
   confirmed phrase that a document of it may hold, as words, compiles them into one
   Aho-Corasick automaton and streams all its documents through it, which locates
   every occurrence. Windows around an occurrence are candidates. (All documents
   through all automata would be quadratic; of the others, none can match.)
3. A shard reports each candidate window once, with its least and largest
   document. Sorted by hash, the least document of all keeps the window; shards with
   a later document are told, and cut the words the window covers.

Copies of whole word sequences need no search, since the least of them holds every
window that the others do. Windows are told apart by 128 bits (two hashes with
multipliers of their own). Shuffled rows are linear in the words; a passage shared by
a third of all documents makes one row per shard at most, and sorted runs, documents
included, are streamed: a task holds the phrases and candidate windows of one shard
and one block of text, whatever keys or texts repeat.

Defined results: null and empty texts have no words; fewer than WINDOW words lose
nothing; a very long text is a block, and its shard's share of windows, by itself, at
about 100 bytes a word; rows that repeat a doc_id are one document for "smaller", and
each is returned; a null doc_id is before all others; an empty table gives no rows;
other columns, whatever their names, are not carried along.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from . import text as tx

WINDOW = 50
PHRASE = 25
#: Bytes of text that one shard, and so one automaton, is meant for.
BUCKET_BYTES = 4 << 20
#: Bytes of text, and rows of numbers, that one task sorts, about.
TASK_BYTES, TASK_ROWS = 64 << 20, 2_000_000
#: Symbols of an automaton's alphabet; a word is written as a fixed number of them.
ALPHABET = 64

_EMPTY = hashlib.sha256(b"").hexdigest()
_LEAST = -(1 << 63)


def winnow(h: np.ndarray, rows: np.ndarray, reach: int) -> np.ndarray:
    """Indices that hold the least of some ``reach`` consecutive hashes of one row (leftmost of ties)."""
    n = len(h)
    if n < reach:
        return np.zeros(0, np.int64)
    # least in sliding windows by doubling; ties go left since `<` keeps the first
    best, width = np.arange(n), 1
    while width < reach:
        step = min(width, reach - width)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(h[b] < h[a], b, a)
        width += step
    whole = rows[: n - reach + 1] == rows[reach - 1 :]
    best = best[whole]
    return np.unique(best)


def _survey(window: int, phrase: int):
    """Per document: words, digest of all words, anchors (two hashes, position)."""

    def run(batches):
        for batch in batches:
            for part, buf, offs in tx.blocks(batch, "text"):
                starts, ends, rows = tx.words(buf, offs)
                n = np.bincount(rows, minlength=part.num_rows)
                head = np.cumsum(n) - n
                at, ph = tx.window_hashes(tx.word_hashes(buf, starts, ends), rows, phrase)
                pick = winnow(ph, rows[at], window - phrase + 1)
                place = at[pick]
                other = tx.prefix_sums(tx.word_hashes(buf, starts, ends, 1), 1) if len(place) else np.zeros(1, np.uint64)
                gh = tx.span_hashes(other, place, place + phrase, 1)
                raw = buf.tobytes()
                whole = [hashlib.sha256(b" ".join(raw[a:b].split())).digest() for a, b in zip(offs.tolist(), offs[1:].tolist())]
                cut = pa.array(np.searchsorted(rows[place], np.arange(part.num_rows + 1)), pa.int32())
                lists = {"h": tx.signed(ph[pick]), "g": tx.signed(gh), "pos": (place - head[rows[place]]).astype(np.int32)}
                yield pa.record_batch({
                    "doc_id": part.column("doc_id"), "th": part.column("th"), "n_words": n, "whole": pa.array(whole, pa.binary()), "n_bytes": np.diff(offs),
                    **{k: pa.ListArray.from_arrays(cut, pa.array(v)) for k, v in lists.items()},
                })

    return run


def _phrases(phrase: int):
    """The words of confirmed anchors, from the documents that are asked for them."""

    def run(batches):
        for batch in batches:
            for part, buf, offs in tx.blocks(batch, "text"):
                starts, ends, rows = tx.words(buf, offs)
                head = np.searchsorted(rows, np.arange(part.num_rows))
                asked = part.column("asked")
                fields = asked.flatten().flatten()
                of = np.repeat(np.arange(part.num_rows), asked.value_lengths().to_numpy())
                first = head[of] + fields[0].to_numpy()
                raw = buf.tobytes()
                words = [b" ".join(raw[a:b].split()) for a, b in zip(starts[first].tolist(), ends[first + phrase - 1].tolist())]
                yield pa.record_batch({"h": fields[1], "g": fields[2], "words": pa.array(words, pa.binary())})

    return run


class Automaton:
    """Locates phrases of ``phrase`` words, given as words with one blank between."""

    def __init__(self, phrases: list[bytes], phrase: int):
        self.phrase = phrase
        buf = np.frombuffer(b"".join(phrases), np.uint8)
        starts, ends, _ = tx.words(buf, np.cumsum([0, *map(len, phrases)]))
        names, ids = np.unique(tx.word_hashes(buf, starts, ends), return_inverse=True)
        self.vocabulary, self.other = tx.Lookup(names), len(names)
        self.width = max(1, int(np.ceil(np.log(max(len(names) + 1, 2)) / np.log(ALPHABET))))
        symbols, step = self._code(ids), phrase * self.width
        self.found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for at in range(0, len(symbols), step):
            self.found.add_word(symbols[at : at + step].tobytes().decode("utf-32-le"), 1)
        self.found.make_automaton()

    def _code(self, ids: np.ndarray) -> np.ndarray:
        """Each id as ``width`` symbols (UTF-32 code units)."""
        out = np.empty((len(ids), self.width), np.uint32)
        for k in range(self.width):
            out[:, k] = 48 + (ids // ALPHABET**k) % ALPHABET
        return out.reshape(-1)

    def locate(self, h: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Word positions where any phrase begins; none crosses a row."""
        ids = self.vocabulary(h).astype(np.int64)
        ids[ids < 0] = self.other
        # a word that no phrase has stands between rows
        edges = np.flatnonzero(rows[1:] != rows[:-1]) + 1
        line = np.insert(ids, edges, self.other)
        text = self._code(line).tobytes().decode("utf-32-le")
        ends = np.fromiter((e for e, _ in self.found.iter(text)), np.int64) + 1
        first = ends[ends % self.width == 0] // self.width - self.phrase
        return first - np.searchsorted(edges + np.arange(len(edges)), first)


def _streamed(batches, open_shard, feed, close):
    """Walk rows sorted by (bucket, doc_id nulls first, th, kind).

    Rows of kind 0 come first in a bucket and are gathered; a row of kind 2 is a
    document, unless a row of the same key and text came just before (a mark of kind 1,
    or the same document again). ``feed`` gets blocks of documents, in order of keys.
    """
    shard, held, last = None, [], None
    state = None
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket = batch.column("bucket").to_numpy()
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        for a, b in zip(edges.tolist(), edges[1:].tolist()):
            if shard is not None and bucket[a] != shard:
                if state is not None:
                    yield from close(shard, state)
                held, state = [], None
            shard, rows = bucket[a], batch.slice(a, b - a)
            kind = rows.column("kind").to_numpy()
            told = int(np.searchsorted(kind > 0, True))
            if told:
                held.append(rows.slice(0, told))
            rows, kind = rows.slice(told), kind[told:]
            if not rows.num_rows:
                continue
            key, th = rows.column("doc_id").to_numpy(), rows.column("th").to_numpy()
            new = np.r_[last != (shard, key[0], th[0]), (key[1:] != key[:-1]) | (th[1:] != th[:-1])]
            last = shard, key[-1], th[-1]
            docs = rows.filter(pa.array(new & (kind == 2)))
            if held and docs.num_rows:
                state = open_shard(held) if state is None else state
                for block in tx.blocks(docs, "data"):
                    yield from feed(state, *block)
    if state is not None:
        yield from close(shard, state)


def _candidates(window: int, phrase: int):
    """Each shard's candidate windows: (h, g, bucket, least and largest document)."""

    def open_shard(held):
        return Automaton([x for batch in held for x in batch.column("data").to_pylist()], phrase), []

    def feed(state, part, buf, offs):
        automaton, out = state
        starts, ends, rows = tx.words(buf, offs)
        h = tx.word_hashes(buf, starts, ends)
        hits = automaton.locate(h, rows) if len(h) else h[:0]
        if not len(hits):
            return ()
        mark = np.zeros(len(h) + 1, np.int64)
        np.add.at(mark, np.maximum(hits - (window - phrase), 0), 1)
        np.add.at(mark, hits + 1, -1)
        at, wh = tx.window_hashes(h, rows, window)
        near = np.cumsum(mark)[at] > 0
        at = at[near]
        other = tx.prefix_sums(tx.word_hashes(buf, starts, ends, 1), 1)
        doc = part.column("doc_id").to_numpy()[rows[at]]
        out.append(np.stack([tx.signed(wh[near]), tx.signed(tx.span_hashes(other, at, at + window, 1)), doc], 1))
        return ()

    def close(shard, state):
        if not state[1]:
            return
        w = np.concatenate(state[1])
        w = w[np.lexsort((w[:, 2], w[:, 1], w[:, 0]))]
        new = np.flatnonzero(np.r_[True, (w[1:, :2] != w[:-1, :2]).any(1)])
        end = np.append(new[1:], len(w)) - 1
        yield pa.record_batch({"h": w[new, 0], "g": w[new, 1], "bucket": np.full(len(new), shard), "lo": w[new, 2], "hi": w[end, 2]})

    return lambda batches: _streamed(batches, open_shard, feed, close)


def _owners(batches):
    """Of windows sorted by (h, g, least document): for shards with a later document, the least of all."""
    last, least = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        h, g, lo = (batch.column(c).to_numpy() for c in ("h", "g", "lo"))
        new = np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])]
        m = lo[np.flatnonzero(new)[np.cumsum(new) - 1]]
        if last == (h[0], g[0]):
            m[(h == h[0]) & (g == g[0])] = least
        last, least = (h[-1], g[-1]), m[-1]
        later = np.flatnonzero(batch.column("hi").to_numpy() > m)
        yield pa.record_batch({"bucket": batch.column("bucket").take(pa.array(later)), "h": h[later], "g": g[later], "owner": m[later]})


def _runs(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Firsts and lasts of the runs of consecutive numbers."""
    new = np.flatnonzero(np.r_[True, np.diff(pos) > 1])
    return pos[new], pos[np.append(new[1:], len(pos)) - 1]


def _cut(window: int):
    """Documents that lose words: (doc_id, th, n_removed, kept_sha256)."""

    def open_shard(held):
        known = np.concatenate([np.stack([b.column(c).to_numpy() for c in ("h", "g", "owner")], 1) for b in held])
        return known[np.lexsort((known[:, 1], known[:, 0]))]

    def feed(known, part, buf, offs):
        starts, ends, rows = tx.words(buf, offs)
        at, wh = tx.window_hashes(tx.word_hashes(buf, starts, ends), rows, window)
        if not len(at):
            return
        wh = tx.signed(wh)
        i = np.searchsorted(known[:, 0], wh)
        there = np.flatnonzero((i < len(known)) & (known[np.minimum(i, len(known) - 1), 0] == wh))
        at, wh, i = at[there], wh[there], i[there]
        other = tx.prefix_sums(tx.word_hashes(buf, starts, ends, 1), 1) if len(at) else np.zeros(1, np.uint64)
        wg = tx.signed(tx.span_hashes(other, at, at + window, 1))
        while True:  # equal first hashes stand together
            wrong = (known[i, 1] != wg) & (i + 1 < len(known)) & (known[np.minimum(i + 1, len(known) - 1), 0] == wh)
            if not wrong.any():
                break
            i = i + wrong
        ids, ths = part.column("doc_id").to_numpy(), part.column("th").to_numpy()
        at = at[(known[i, 1] == wg) & (known[i, 2] < ids[rows[at]])]
        of = rows[at]
        head = np.searchsorted(rows, np.arange(part.num_rows))
        out = {"doc_id": [], "th": [], "n_removed": [], "kept_sha256": []}
        edges = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]) if len(of) else []
        for a, b in zip(edges, edges[1:]):
            row = of[a]
            w = buf[offs[row] : offs[row + 1]].tobytes().split()
            kept, last = [], 0
            for first, end in zip(*(x.tolist() for x in _runs(at[a:b] - head[row]))):
                kept += w[last:first]
                last = max(last, end + window)
            kept += w[last:]
            for k, v in zip(out, (ids[row], ths[row], len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())):
                out[k].append(v)
        if out["doc_id"]:
            yield pa.record_batch(out)

    return lambda batches: _streamed(batches, open_shard, feed, lambda shard, state: ())


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, phrase: int = PHRASE, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of ``docs``."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_LEAST)).alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).cast("binary").alias("text"))
    schema = "doc_id long, th long, n_words long, whole binary, n_bytes long, h array<long>, g array<long>, pos array<int>"
    survey = store.written(rows.mapInArrow(_survey(window, phrase), schema), "survey")
    total = survey.agg(F.sum("n_bytes")).first()[0] or 0
    texts = store.partitions(spark, total, TASK_BYTES)
    bucket = F.pmod(F.xxhash64("doc_id", "th"), F.lit(max(1, -(-total // bucket_bytes)))).alias("bucket")
    least = store.written(survey.groupBy("whole").agg(F.min("doc_id").alias("least")), "least")
    known = survey.select("doc_id", "th", "n_words", "whole").join(least, "whole").withColumn("copy", F.col("doc_id") > F.col("least"))
    known = store.written(known.drop("least"), "known")
    store.drop(spark, least)
    copies = known.where("copy").select("doc_id", "th")

    anchors = survey.where("size(h) > 0").join(copies, ["doc_id", "th"], "left_anti").select("doc_id", "th", F.explode(F.arrays_zip("h", "g", "pos")).alias("a")).select("a.h", "a.g", "doc_id", "th", "a.pos")
    # counted with map-side sums, then met in joins that can be split: a common anchor is no single task
    seen = anchors.groupBy("h", "g").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("h", "g", "x")
    seen = store.written(seen, "seen")  # a table of its own, so that the join with it can be split
    recurring = store.written(anchors.join(seen, ["h", "g"]), "recurring")
    asked = recurring.where("doc_id = x").groupBy("doc_id", "th").agg(F.collect_list(F.struct("pos", "h", "g")).alias("asked"))
    words = rows.join(asked, ["doc_id", "th"]).mapInArrow(_phrases(phrase), "h long, g long, words binary")
    phrases = store.written(words.groupBy("h", "g").agg(F.max("words").alias("words")), "phrases")
    told = recurring.select("h", "g", bucket).distinct().join(phrases, ["h", "g"])

    no, number = F.lit(None).cast("long"), F.lit(None).cast("binary")
    dealt = rows.select(bucket, "doc_id", "th", F.lit(2).alias("kind"), F.col("text").alias("data"))
    marks = copies.distinct().select(bucket, "doc_id", "th", F.lit(1).alias("kind"), number.alias("data"))
    line = ["bucket", F.col("doc_id").asc_nulls_first(), F.col("th").asc_nulls_first(), "kind"]
    sent = told.select("bucket", no.alias("doc_id"), no.alias("th"), F.lit(0).alias("kind"), F.col("words").alias("data"))
    found = dealt.union(marks).union(sent).repartition(texts, "bucket").sortWithinPartitions(*line)
    found = store.written(found.mapInArrow(_candidates(window, phrase), "h long, g long, bucket long, lo long, hi long"), "windows")
    for done in (seen, recurring, phrases, survey):
        store.drop(spark, done)
    n = store.partitions(spark, found.count(), TASK_ROWS)
    owners = found.repartition(n, "h").sortWithinPartitions("h", "g", "lo").mapInArrow(_owners, "bucket long, h long, g long, owner long")
    owners = store.written(owners, "owners")
    store.drop(spark, found)

    both = [*(no.alias(c) for c in ("h", "g", "owner"))]
    sent = owners.select("bucket", no.alias("doc_id"), no.alias("th"), F.lit(0).alias("kind"), number.alias("data"), "h", "g", "owner")
    rest = dealt.union(marks).select("*", *both).union(sent).repartition(texts, "bucket").sortWithinPartitions(*line)
    cut = rest.mapInArrow(_cut(window), "doc_id long, th long, n_removed long, kept_sha256 string")
    gone = F.col("copy") & (F.col("n_words") >= window)
    return known.join(cut, ["doc_id", "th"], "left").select(
        F.when(F.col("doc_id") != _LEAST, F.col("doc_id")).alias("doc_id"), "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("whole")))).alias("kept_sha256"),
    )

"""Benchmark decontamination: a BM25 index of test items, queried by every training passage.

Items are indexed: per term its postings (item, impact), its largest impact, and its
largest impact in each block of BLOCK_ITEMS consecutive items. Passages of a text
overlap by half, so any span of an item's length lies within one. A passage retrieves
*all* items whose score reaches THRESHOLD of the item's own score for itself, by
block-max WAND: a cursor per term; terms in the order of their cursors' items; the
pivot is the first item that the largest impacts up to it can lift to the threshold;
if the block maxima there can't, all cursors go on behind the block, else to the
pivot, which is scored. Many passages take each step at once, in numpy. Hits are
verified: the passage must hold enough of the word triples of the item's question and
of its answer (its last sentence).

Document frequencies, the mean length and the longest item are those of *all* items.
An index of a bounded number of bytes of items is broadcast; a larger benchmark is cut
into several, which score as one would, and texts stream through one after the other,
written in between, so that one index is held at a time. No shuffle of texts.

Defined results: null and empty texts and items match nothing; an item without an id
is no item; an item of one sentence is question and answer at once; scores
equal to nine decimals report the least item_id, and items of equal id count as their number; repeated rows
are judged alike; a text of more than PIECE bytes is cut into overlapping pieces,
whose passages start anew, so memory doesn't grow with it; an empty table gives no
rows, and an empty benchmark flags none; columns named like result columns are
replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store
from . import text as tx

K1, B = 1.2, 0.75
THRESHOLD = 0.5
QUESTION_OVERLAP, ANSWER_OVERLAP = 0.6, 0.5
GRAM = 3
BLOCK_ITEMS = 16
PASSAGE = 64
#: Bytes of items in one broadcast index, and of text that is searched at once.
INDEX_BYTES, PIECE = 8 << 20, 4 << 20
#: Cursors that take a step at once.
CURSORS = 1 << 16
APART = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
STOP = np.zeros(256, bool)
STOP[[33, 46, 63, 10]] = True
#: Below any sum of rounding errors of impacts, and the decimals by which scores are told apart.
SLACK, DIGITS = 1e-9, 9


def _words(buf: np.ndarray, offs: np.ndarray):
    buf = tx.LOWER[buf]
    starts, ends, rows = tx.spans(APART[buf], offs)
    return tx.word_hashes(buf, starts, ends), rows, starts


def _triples(h: np.ndarray) -> np.ndarray:
    n = min(GRAM, len(h))
    return tx.window_hashes(h, np.zeros(len(h), np.int64), n)[1] if n else np.zeros(0, np.uint64)


def _triples_all(h: np.ndarray) -> np.ndarray:
    z = np.zeros(len(h), np.int64)
    return np.concatenate([tx.window_hashes(h, z, n)[1] for n in range(1, GRAM + 1)])


class Stats:
    """Of all items: their number, mean and largest length, and the document frequency of terms (ascending)."""

    def __init__(self, n: int, mean: float, longest: int, terms: np.ndarray, df: np.ndarray):
        self.n, self.mean, self.longest, self.terms, self.df = n, mean, longest, terms, df

    @staticmethod
    def of(texts: list[bytes]) -> Stats:
        h, rows, _ = _words(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        size = np.bincount(rows, minlength=len(texts))
        pairs = np.unique(np.stack([h, rows.astype(np.uint64)]), axis=1)
        terms, df = np.unique(pairs[0], return_counts=True)
        return Stats(len(texts), float(size.mean()) if len(texts) else 0.0, int(size.max(initial=0)), terms, df)


class Index:
    def __init__(self, ids: list[int], texts: list[bytes], stats: Stats | None = None):
        stats = stats or Stats.of(texts)
        offs = np.cumsum([0, *map(len, texts)])
        buf = np.frombuffer(b"".join(texts), np.uint8)
        h, rows, starts = _words(buf, offs)
        self.ids, n = np.array(ids, np.int64), len(ids)
        size = np.bincount(rows, minlength=n)
        self.step = max(PASSAGE, stats.longest)
        # question: all sentences but the last; answer: the last
        stops = np.concatenate([[0], np.cumsum(STOP[buf])])[starts] if len(starts) else np.zeros(0, np.int64)
        self.question, self.answer = [], []
        edges = np.searchsorted(rows, np.arange(n + 1)).tolist()
        for a, b in zip(edges, edges[1:]):
            cut = a + int(np.searchsorted(stops[a:b], stops[b - 1])) if b > a else a
            self.question.append(np.unique(_triples(h[a : cut if cut > a else b])))
            self.answer.append(np.unique(_triples(h[cut:b])))
        terms, t = np.unique(h, return_inverse=True)
        self.n = n
        key, tf = np.unique(t.astype(np.int64) * max(n, 1) + rows, return_counts=True)
        term, item = key // max(n, 1), key % max(n, 1)
        df = stats.df[np.searchsorted(stats.terms, terms)] if len(terms) else np.zeros(0)
        idf = np.log1p((stats.n - df + 0.5) / (df + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / max(stats.mean, 1e-9)))
        impact /= np.bincount(item, weights=impact, minlength=n)[item]
        self.find = tx.Lookup(terms)
        # one ascending key per posting, so that every cursor moves by one binary search
        self.key, self.item, self.impact = key, item, impact
        self.ptr = np.searchsorted(term, np.arange(len(terms) + 1))
        self.most = np.maximum.reduceat(impact, self.ptr[:-1]) if len(terms) else impact
        bkey = term * (n // BLOCK_ITEMS + 1) + item // BLOCK_ITEMS
        first = np.flatnonzero(np.r_[True, bkey[1:] != bkey[:-1]]) if len(bkey) else np.zeros(0, np.int64)
        # of each posting the largest impact of its term in its block
        self.bmost = np.repeat(np.maximum.reduceat(impact, first), np.diff(np.append(first, len(bkey)))) if len(first) else impact
        # the most frequent terms open no passage as long as no item gets near the threshold by them alone
        self.opens, sums = np.ones(len(terms), bool), np.zeros(n)
        for x in np.lexsort((np.arange(len(terms)), -np.diff(self.ptr))):
            p = slice(self.ptr[x], self.ptr[x + 1])
            if (sums[item[p]] + impact[p] >= THRESHOLD * 0.98).any():
                break
            sums[item[p]] += impact[p]
            self.opens[x] = False

    def _seek(self, term: np.ndarray, at: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each term, whose cursor stands on posting ``at``, the first posting at or behind a larger item than that: its place, and its item (n: none)."""
        at, stop = at + 1, self.ptr[term + 1]
        doc = np.where(at < stop, self.item[np.minimum(at, len(self.item) - 1)], self.n)
        far = np.flatnonzero(doc < item)  # not the next one
        if len(far):
            at[far] = np.searchsorted(self.key, term[far] * max(self.n, 1) + item[far])
            doc[far] = np.where(at[far] < stop[far], self.item[np.minimum(at[far], len(self.item) - 1)], self.n)
        return at, doc

    def wand(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, item, score) of all items at the threshold, for queries x terms (-1: no term), all walked at once."""
        small = np.int16 if self.n < 1 << 14 else np.int64  # short keys sort by radix
        real = terms >= 0
        t = np.maximum(terms, 0)
        most = np.where(real, self.most[t], 0.0)
        at = self.ptr[t]
        doc = np.where(real, self.item[at], self.n).astype(small)
        who = np.arange(len(t))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

        def move(behind):
            """Cursors before a query's place, n at most, go there."""
            i = np.flatnonzero(doc < behind.astype(small)[:, None])
            if len(i):
                at.reshape(-1)[i], doc.reshape(-1)[i] = self._seek(t.reshape(-1)[i], at.reshape(-1)[i], behind[i // t.shape[1]])

        while len(who):
            order = np.argsort(doc, axis=1, kind="stable")
            line = np.arange(len(who))
            bound = np.cumsum(most[line[:, None], order], axis=1)
            place = (bound < THRESHOLD - SLACK).sum(1)
            go = place < t.shape[1]
            pivot = doc[line, order[line, np.minimum(place, t.shape[1] - 1)]].astype(np.int64)
            go &= pivot < self.n
            if not go.all():
                who, t, most, at, doc, pivot = (x[go] for x in (who, t, most, at, doc, pivot))
                if not len(who):
                    break
            # nothing before the pivot can reach the threshold, so all cursors go to its block
            start = pivot - pivot % BLOCK_ITEMS
            move(start)
            end = np.minimum(start + BLOCK_ITEMS, self.n)
            here = np.where(doc < end[:, None], self.bmost[np.minimum(at, len(self.bmost) - 1)], 0.0)
            near = doc <= pivot[:, None]
            scored = (here * near).sum(1) >= THRESHOLD - SLACK
            # behind the block if all its maxima can't reach the threshold, or on to the next term's cursor if those up to the pivot can't
            further = np.minimum(end, np.where(near, self.n, doc).min(1))
            move(np.where(scored, pivot, np.where(here.sum(1) >= THRESHOLD - SLACK, np.maximum(further, pivot + 1), end)))
            full = np.flatnonzero(scored)
            if len(full):
                r, c = np.nonzero(doc[full] == pivot[full, None])
                score = np.bincount(r, weights=self.impact[at[full][r, c]], minlength=len(full))
                ok = score >= THRESHOLD
                out.append((who[full[ok]], pivot[full[ok]], score[ok]))
                move(np.where(scored, pivot + 1, 0))
        return tuple(np.concatenate(x) for x in zip(*out))

    def matches(self, buf: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, float, float, float]]:
        """(row, item index, score, question overlap, answer overlap) of verified hits."""
        h, rows, _ = _words(buf, offs)
        if not self.n or not len(h):
            return []
        t = self.find(h)
        head = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        place = np.arange(len(h)) - np.repeat(head, np.diff(np.append(head, len(h))))
        # chunk numbers never touch across rows; passage p is chunks p and p + 1
        chunk = place // self.step + np.cumsum(np.r_[0, np.where(rows[1:] != rows[:-1], place[:-1] // self.step + 2, 0)])
        known = t >= 0
        opened = np.unique(chunk[known & self.opens[np.maximum(t, 0)]])
        opened = np.unique(np.concatenate([opened, opened - 1]))
        if not len(opened):
            return []
        pairs = []
        for shift in (0, 1):
            i = np.minimum(np.searchsorted(opened, chunk - shift), len(opened) - 1)
            ok = known & (opened[i] == chunk - shift)
            pairs.append(i[ok] * np.int64(len(self.ptr)) + t[ok])
        pairs = np.sort(np.concatenate(pairs))  # np.unique would hash them first
        pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]]
        passage, term = pairs // len(self.ptr), pairs % len(self.ptr)
        # a passage whose terms' largest impacts don't add up to the threshold has no pivot
        able = np.bincount(passage, weights=self.most[term], minlength=len(opened)) >= THRESHOLD - SLACK
        n = np.where(able, np.bincount(passage, minlength=len(opened)), 0)
        first = np.cumsum(np.bincount(passage, minlength=len(opened))) - np.bincount(passage, minlength=len(opened))
        order = np.argsort(-n, kind="stable")
        order = order[n[order] > 0]
        out = []
        lo, hi = np.searchsorted(chunk, opened), np.searchsorted(chunk, opened + 1, "right")
        done = 0
        while done < len(order):
            wide = int(n[order[done]])
            some = order[done : done + max(1, CURSORS // wide)]
            done += len(some)
            grid = np.arange(wide)[None, :]
            cell = np.minimum(first[some][:, None] + grid, len(term) - 1)
            queries = np.where(grid < n[some][:, None], term[cell], -1)
            for q, item, s in zip(*(x.tolist() for x in self.wand(queries))):
                p = some[q]
                own = _triples_all(h[lo[p] : hi[p]])
                share = [float(np.isin(x, own).mean()) if len(x) else 0.0 for x in (self.question[item], self.answer[item])]
                if share[0] >= QUESTION_OVERLAP and share[1] >= ANSWER_OVERLAP:
                    out.append((int(rows[lo[p]]), item, round(min(s, 1.0), DIGITS), *share))
        return out


def _pieces(buf: np.ndarray, offs: np.ndarray, overlap: int, limit: int):
    """A block's texts, or one long text in pieces of about ``limit`` bytes that overlap, cut between words."""
    if len(offs) > 2 or len(buf) <= limit:
        yield buf, offs
        return
    at = 0
    while at < len(buf):
        to = min(len(buf), at + limit)
        while to < len(buf) and not APART[buf[to]]:
            to += 1
        yield buf[at:to], np.array([0, to - at])
        if to == len(buf):
            return
        # step back over enough words that a span of an item's length lies in one of both pieces
        words, at = 0, to
        while at > 0 and words < overlap and to - at < limit // 2:
            back = max(0, at - (1 << 16))
            starts, _, _ = tx.spans(APART[buf[back:at]], np.array([0, at - back]))
            if words + len(starts) >= overlap:
                at = back + int(starts[len(starts) - (overlap - words)])
                break
            words, at = words + len(starts), back


def _run(shared, text: str, columns: list[str], piece: int):
    def run(batches):
        index = shared.value
        for batch in batches:
            for part, buf, offs in tx.blocks(batch, text, 2 * tx.BLOCK):
                score, count = (part.column(c).to_numpy(zero_copy_only=False).copy() for c in ("best_score", "n_items"))
                item, seen = part.column("best_item").to_pylist(), set()
                for some, cut in _pieces(buf, offs, 2 * index.step, piece):
                    for row, i, s, _, _ in index.matches(some, cut):
                        count[row] += (row, i) not in seen
                        seen.add((row, i))
                        x = int(index.ids[i])
                        if s > score[row] or s == score[row] and (item[row] is None or x < item[row]):
                            score[row], item[row] = s, x
                own = {"best_score": pa.array(score), "best_item": pa.array(item, pa.int64()), "n_items": pa.array(count)}
                yield pa.record_batch([own.get(c, part.column(c) if c in part.schema.names else None) for c in columns], names=columns)

    return run


def _terms(batches):
    """(item number, length, term) once for each term of an item; term null for an item's length."""
    for batch in batches:
        for part, buf, offs in tx.blocks(batch, "t"):
            h, rows, _ = _words(buf, offs)
            size = np.bincount(rows, minlength=part.num_rows)
            pairs = np.unique(np.stack([rows.astype(np.uint64), h]), axis=1)
            term = pa.array(np.r_[np.zeros(part.num_rows, np.int64), tx.signed(pairs[1])], mask=np.arange(part.num_rows + pairs.shape[1]) < part.num_rows)
            of = np.r_[np.arange(part.num_rows), pairs[0].astype(np.int64)]
            yield pa.record_batch({"part": part.column("part").take(pa.array(of)), "size": size[of].astype(np.int64), "term": term})


def flag(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", index_bytes: int = INDEX_BYTES, piece: int = PIECE) -> DataFrame:
    """``docs`` with n_items (verified items), best_item and best_score; n_items > 0: contaminated."""
    spark = docs.sparkSession
    items = benchmark.where(F.col(item_text).isNotNull() & F.col(item).isNotNull()).select(F.col(item).cast("long").alias("i"), F.col(item_text).cast("binary").alias("t"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    parts = max(1, -(-total // index_bytes))
    items = items.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(parts)).cast("long"))
    # statistics of all items; a part is told those of its own terms
    terms = store.written(items.select("t", "part").mapInArrow(_terms, "part long, size long, term long"), "terms")
    n, mean, longest = terms.where("term IS NULL").agg(F.count("*"), F.avg("size"), F.max("size")).first()
    df = terms.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"))
    own = store.written(terms.where("term IS NOT NULL").select("part", "term").distinct().join(df, "term"), "frequencies")
    result = ["n_items", "best_item", "best_score"]
    out = docs.select(*store.free(docs.columns, result), F.lit(0).cast("long").alias("n_items"), F.lit(None).cast("long").alias("best_item"), F.lit(0.0).alias("best_score"))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema])
    for k in range(parts):
        some = own.where(F.col("part") == k).select("term", "df").toArrow()
        h, count = some["term"].to_numpy().view(np.uint64), some["df"].to_numpy()
        by = np.argsort(h)
        rows = sorted((r.i, bytes(r.t)) for r in items.where(F.col("part") == k).toLocalIterator())
        index = Index([i for i, _ in rows], [t for _, t in rows], Stats(n, mean or 0.0, longest or 0, h[by], count[by]))
        shared = spark.sparkContext.broadcast(index)
        out = out.mapInArrow(_run(shared, text, out.columns, piece), schema)
        if k + 1 < parts:
            out = store.written(out, "flagged")
            shared.unpersist()
    return out

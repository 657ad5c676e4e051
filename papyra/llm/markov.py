"""A hidden Markov language model over words.

States emit word classes. The HEAD most frequent training words are classes of
their own; every other word belongs to one of SHAPES classes by the hash of its
last bytes, and has the probability (c + 0.5) / (N_g + 0.5 (V_g + 1)) in its
class g, from the counts of *all* training words (an unknown word: c = 0). The
text's likelihood is the exact forward sum over state paths times these.

Counts of all words are aggregated over the corpus. Baum-Welch starts from a
bounded sample and then takes PASSES full passes over all training texts, whose
expected counts are summed across partitions (as fixed-point integers, so that
the order of addition doesn't matter). A text is worked off in segments of SEGMENT
tokens; the forward vector before a segment and the backward vector behind it come
from the segments' transfer matrices, so the counts are those of the whole text.
Scoring runs the scaled forward recursion over the whole text. The COMMON most
frequent words have their counts broadcast (a fixed size); rarer words meet
theirs in a join, one row per text and word.

Defined results: null and empty texts are the end token alone; without training
texts every token has the base probability of an unknown one; a very long text is
learned from and scored whole, in one block, at about 300 bytes a token; repeated
rows and null keys are scored alike and all returned; an empty table gives no rows;
other input columns, whatever their names, are not carried along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from . import text as tx

STATES = 8
HEAD = 8192
COMMON = 65536
SHAPES = 4096
TAIL_BYTES = 4
#: Training texts that the starting point is fitted on, about.
START_TEXTS = 1500
START_ROUNDS = 12
PASSES = 2
#: Tokens of a text that are worked off at once; of a text in the sample one such segment is taken.
SEGMENT = 1024
BATCH = 256
SCALE = 1 << 20
SMOOTH = 0.05
END = np.uint64(0xE0D0E0D0E0D0E0D1)
_BLOCK = 2 << 20


def _tokens(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, shape and row of each token; every row closes with END."""
    buf = tx.LOWER[buf]
    starts, ends, rows = tx.words(buf, offs)
    sums = tx.byte_sums(buf)
    h = tx.span_hashes(sums, starts, ends)
    shape = (tx.span_hashes(sums, np.maximum(starts, ends - TAIL_BYTES), ends) % np.uint64(SHAPES)).astype(np.int32)
    at = np.cumsum(np.bincount(rows, minlength=n))  # where each row's END goes
    return np.insert(h, at, END), np.insert(shape, at, 0), np.insert(rows, at, np.arange(n))


def _count(batches):
    held, size = [], 0

    def flush():
        pairs = np.concatenate(held)
        by = np.argsort(pairs["h"], kind="stable")
        pairs = pairs[by]
        new = np.flatnonzero(np.r_[True, pairs["h"][1:] != pairs["h"][:-1]])
        return np.rec.fromarrays([pairs["h"][new], pairs["c"][new], np.add.reduceat(pairs["n"], new)], names="h,c,n")

    for batch in batches:
        for part, buf, offs in tx.blocks(batch, "text", _BLOCK):
            h, shape, _ = _tokens(buf, offs, part.num_rows)
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            held.append(np.rec.fromarrays([u, shape[first], n], names="h,c,n"))
            size += len(u)
            if size > 3_000_000:
                held = [flush()]
                size = len(held[0])
                if size > 2_000_000:
                    yield _counted(held.pop())
                    size = 0
    if held:
        yield _counted(flush())


def _counted(x) -> pa.RecordBatch:
    return pa.record_batch({"h": np.ascontiguousarray(x["h"]).view(np.int64), "c": np.ascontiguousarray(x["c"]), "n": np.ascontiguousarray(x["n"])})


class Lexicon:
    """The common words by rank: hash lookup (-1: not common), counts, and what each shape class holds."""

    def __init__(self, h: np.ndarray, n: np.ndarray, head: int, class_n: np.ndarray, class_v: np.ndarray):
        self.n, self.head = n, head
        self.rank = tx.Lookup(h)
        self.norm = np.log10(class_n + 0.5 * (class_v + 1))
        self.classes = head + SHAPES

    def classify(self, rank: np.ndarray, shape: np.ndarray) -> np.ndarray:
        return np.where((rank >= 0) & (rank < self.head), rank, self.head + shape)


class Model:
    def __init__(self, initial, move, emit):
        self.initial, self.move, self.emit = initial, move, emit  # emit: classes x states

    @staticmethod
    def of_counts(initial, move, emit) -> Model:
        norm = lambda x, axis: (x + SMOOTH) / (x + SMOOTH).sum(axis, keepdims=True)
        return Model(norm(initial, 0), norm(move, 1), norm(emit, 0))


def _ragged(first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For runs of falling length: places step by step, how many runs each step has, and where steps begin."""
    live = np.searchsorted(-length, -np.arange(length[0]), "left")
    edge = np.r_[0, np.cumsum(live)]
    step = np.repeat(np.arange(len(live)), live)
    return first[np.arange(edge[-1]) - edge[step]] + step, live, edge


def _transfer(model: Model, flat: np.ndarray, first: np.ndarray, length: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """What each segment makes of the state before it (k x k, up to a factor); one that opens a text starts afresh."""
    k = len(model.move)
    out = np.empty((len(first), k, k))
    order = np.argsort(-length, kind="stable")
    for some in np.split(order, range(BATCH, len(order), BATCH)):
        at, live, edge = _ragged(first[some], length[some])
        e = model.emit[flat[at]]
        m = np.where(opens[some][:, None, None], np.tile(model.initial, (k, 1)), model.move)
        for t, n in enumerate(live):
            m[:n] = (m[:n] if t == 0 else (m[:n].reshape(-1, k) @ model.move).reshape(n, k, k)) * e[edge[t] : edge[t + 1], None, :]
            m[:n] /= m[:n].max((1, 2), keepdims=True)
        out[some] = m
    return out


def _borders(model: Model, flat: np.ndarray, first: np.ndarray, length: np.ndarray, text: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each segment the forward vector before it and the backward vector at its end."""
    k = len(model.move)
    before, after = np.tile(model.initial, (len(text), 1)), np.ones((len(text), k))
    many = np.flatnonzero(np.bincount(text)[text] > 1)
    if len(many):
        move = _transfer(model, flat, first[many], length[many], number[many] == 0)
        n, t = number[many], text[many]
        by = np.argsort(n, kind="stable")
        edge = np.searchsorted(n[by], np.arange(n.max() + 2))
        for j in range(1, n.max() + 1):  # segments stand text by text, so the one before is the row before
            here = by[edge[j] : edge[j + 1]]
            v = np.einsum("bi,bij->bj", before[many[here - 1]], move[here - 1]) if j > 1 else move[here - 1][:, 0]
            before[many[here]] = v / v.sum(1, keepdims=True)
        for j in range(n.max() - 1, -1, -1):
            here = by[edge[j] : edge[j + 1]]
            here = here[(here + 1 < len(t)) & (t[np.minimum(here + 1, len(t) - 1)] == t[here])]
            v = np.einsum("bij,bj->bi", move[here + 1], after[many[here + 1]])
            after[many[here]] = v / v.max(1, keepdims=True)
    return before, after


def expect(model: Model, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts (initial, move, emit) of class sequences, none empty, and their log likelihood."""
    k = len(model.move)
    emit, move, initial, loglik = np.zeros(model.emit.shape), np.zeros((k, k)), np.zeros(k), 0.0
    size, flat = np.array([len(s) for s in seqs]), np.concatenate(seqs)
    pieces = -(-size // SEGMENT)
    text = np.repeat(np.arange(len(seqs)), pieces)
    number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = (np.cumsum(size) - size)[text] + number * SEGMENT
    length = np.minimum(SEGMENT, size[text] - number * SEGMENT)
    before, after = _borders(model, flat, first, length, text, number)
    order = np.argsort(-length, kind="stable")
    for some in np.split(order, range(BATCH, len(order), BATCH)):
        at, live, edge = _ragged(first[some], length[some])
        opens = number[some] == 0
        e = model.emit[flat[at]]
        alpha, scale = np.empty((len(at), k)), np.empty(len(at))
        for t, n in enumerate(live):
            now = slice(edge[t], edge[t + 1])
            a = np.where(opens[:, None], model.initial, before[some] @ model.move) if t == 0 else alpha[edge[t - 1] : edge[t - 1] + n] @ model.move
            a = a * e[now]
            scale[now] = a.sum(1)
            alpha[now] = a / scale[now, None]
        loglik += np.log(scale).sum()
        last = edge[length[some] - 1] + np.arange(len(some))
        beta = after[some] / (alpha[last] * after[some]).sum(1, keepdims=True)
        gamma = np.empty((len(at), k))
        for t in range(len(live) - 1, -1, -1):
            now = slice(edge[t], edge[t + 1])
            gamma[now] = alpha[now] * beta[: live[t]]
            w = e[now] * beta[: live[t]] / scale[now, None]
            if t:
                move += (alpha[edge[t - 1] : edge[t - 1] + live[t]].T @ w) * model.move
                beta[: live[t]] = w @ model.move.T
            else:
                move += (before[some][~opens].T @ w[~opens]) * model.move
        initial += gamma[: live[0]][opens].sum(0)
        for j in range(k):
            emit[:, j] += np.bincount(flat[at], weights=gamma[:, j], minlength=len(emit))
    return initial, move, emit, loglik


def sequences(classes: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    return np.split(classes, np.flatnonzero(rows[1:] != rows[:-1]) + 1)


def _classes(lexicon):
    """A segment of each text, chosen by the text's hash, as classes."""

    def run(batches):
        lex = lexicon.value
        for batch in batches:
            for part, buf, offs in tx.blocks(batch, "text", _BLOCK):
                h, shape, rows = _tokens(buf, offs, part.num_rows)
                c = lex.classify(lex.rank(h), shape).astype(np.int32)
                some = [s[i : i + SEGMENT] for s, x in zip(sequences(c, rows), part.column("th").to_pylist()) for i in [x % -(-len(s) // SEGMENT) * SEGMENT]]
                yield pa.record_batch({"c": pa.array(some, pa.list_(pa.int32()))})

    return run


def _start(seqs: list[np.ndarray], classes: int, rng: np.random.Generator) -> Model:
    """A mixture over texts gives the states; EM on the sample refines them."""
    k, d = STATES, np.repeat(np.arange(len(seqs)), [len(s) for s in seqs])
    flat = np.concatenate(seqs)
    who = rng.integers(0, k, len(seqs))
    for _ in range(8):
        emit = np.stack([np.bincount(flat, weights=(who[d] == j).astype(float), minlength=classes) for j in range(k)], 1) + SMOOTH
        log = np.log(emit / emit.sum(0))
        size = np.log(np.bincount(who, minlength=k) + 1.0)
        who = np.stack([np.bincount(d, weights=log[flat, j]) + size[j] for j in range(k)], 1).argmax(1)
    share = np.bincount(who, minlength=k) + 1.0
    model = Model.of_counts(share, 0.9 * len(flat) / k * np.eye(k) + 0.1 * len(flat) / k / k, emit)
    for _ in range(START_ROUNDS):
        model = Model.of_counts(*expect(model, seqs)[:3])
    return model


def _passes(shared):
    def run(batches):
        lex, model = shared.value
        k = model.move.shape[0]
        total = [np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.shape)]
        for batch in batches:
            for part, buf, offs in tx.blocks(batch, "text", _BLOCK):
                h, shape, rows = _tokens(buf, offs, part.num_rows)
                for x, y in zip(total, expect(model, sequences(lex.classify(lex.rank(h), shape), rows))):
                    x += y
        table = np.vstack([total[0][None], total[1], total[2]])
        some = np.flatnonzero(table.any(1))
        fixed = np.rint(table[some] * SCALE).astype(np.int64)
        yield pa.record_batch({"cell": some, **{f"s{j}": np.ascontiguousarray(fixed[:, j]) for j in range(k)}})

    return run


def forward(model: Model, classes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """log10 likelihood of each row's class sequence by the scaled forward recursion."""
    size = np.bincount(rows, minlength=n)
    head = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    size, head = size[order], head[order]
    live = np.searchsorted(-size, -np.arange(size[0] if n else 0), "left")
    out = np.zeros(n)
    a = np.tile(model.initial, (n, 1))
    for t in range(len(live)):
        m = live[t]
        a = (a[:m] if t == 0 else a[:m] @ model.move) * model.emit[classes[head[:m] + t]]
        s = a.sum(1)
        a /= s[:, None]
        out[:m] += np.log10(s)
    back = np.empty(n)
    back[order] = out
    return back


def _score(shared):
    """Rows of two kinds: texts (h null) and, of their rarer words, (h, times)."""

    def run(batches):
        lex, model = shared.value
        log = np.log10(lex.n + 0.5)
        for batch in batches:
            for part, buf, offs in tx.blocks(batch, "text", _BLOCK):
                n = part.num_rows
                h, shape, rows = _tokens(buf, offs, n)
                rank = lex.rank(h)
                common = rank >= 0
                lp = np.where(common, log[np.maximum(rank, 0)] if len(log) else 0.0, 0.0)
                total = lambda w: np.bincount(rows, weights=w, minlength=n)  # noqa: E731, B023
                shaped = (rank < 0) | (rank >= lex.head)
                inner = forward(model, lex.classify(rank, shape), rows, n) + total(np.where(shaped, lp - lex.norm[shape], 0.0))
                yield _rows(part, np.arange(n), None, np.bincount(rows, minlength=n), total(common).astype(np.int64), total(lp), inner)
                rare = np.flatnonzero(~common)
                if len(rare):
                    by = rare[np.lexsort((h[rare], rows[rare]))]
                    new = np.flatnonzero(np.r_[True, (h[by][1:] != h[by][:-1]) | (rows[by][1:] != rows[by][:-1])])
                    times = np.diff(np.append(new, len(by)))
                    zero = np.zeros(len(new))
                    yield _rows(part, rows[by[new]], h[by[new]].view(np.int64), times, zero.astype(np.int64), zero, zero)

    return run


def _rows(part, at, h, n, known, base, inner):
    take = pa.array(at)
    return pa.record_batch({
        "doc_id": part.column("doc_id").take(take), "th": part.column("th").take(take), "held_out": part.column("held_out").take(take),
        "h": pa.nulls(len(at), pa.int64()) if h is None else pa.array(h), "n": n, "known": known, "base": base, "inner": inner,
    })


def score(docs: DataFrame, held_out: Column, text: str = "text", key: str = "doc_id", passes: int = PASSES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    ``held_out`` is true of the texts that nothing is learned from.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("th"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).cast("binary").alias("text"))
    train = rows.where(~F.col("held_out"))
    counts = store.written(train.select("text").mapInArrow(_count, "h long, c int, n long").groupBy("h").agg(F.first("c").alias("c"), F.sum("n").alias("n")), "counts")

    n_all, v_all = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    common = counts.orderBy(F.col("h").cast("long") != int(END.view(np.int64)), F.desc("n"), "h").limit(COMMON).toArrow()
    h, c, n = common["h"].to_numpy().view(np.uint64), common["c"].to_numpy(), common["n"].to_numpy()
    head = min(HEAD, len(h))
    class_n, class_v = np.zeros(SHAPES), np.zeros(SHAPES)
    for row in counts.groupBy("c").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        class_n[row.c], class_v[row.c] = row.n, row.v
    class_n -= np.bincount(c[:head], weights=n[:head], minlength=SHAPES)
    class_v -= np.bincount(c[:head], minlength=SHAPES)
    lex = Lexicon(h, n, head, class_n, class_v)

    if n_all:
        texts = int(n[0])  # END closes each
        # by row, so copies of a text are drawn no more often than others, and one for each text
        drawn = F.pmod(F.xxhash64("doc_id", "th", F.lit("start")), F.lit(1 << 30)) < int(min(1.0, START_TEXTS / texts) * (1 << 30))
        sample = train.where(drawn).select("th", "text").dropDuplicates(["th"])
        got = sample.mapInArrow(_classes(spark.sparkContext.broadcast(lex)), "c array<int>").toArrow()["c"]
        seqs = [np.asarray(x.values, np.int64) for x in got] or [np.zeros(1, np.int64)]
        model = _start(seqs, lex.classes, np.random.default_rng(0))
        for _ in range(passes):
            cells = train.select("text").mapInArrow(_passes(spark.sparkContext.broadcast((lex, model))), "cell long, " + ", ".join(f"s{j} long" for j in range(STATES)))
            got = cells.groupBy("cell").agg(*(F.sum(f"s{j}").alias(f"s{j}") for j in range(STATES))).toArrow()
            table = np.zeros((1 + STATES + lex.classes, STATES))
            table[got["cell"].to_numpy()] = np.stack([got[f"s{j}"].to_numpy() for j in range(STATES)], 1) / SCALE
            model = Model.of_counts(table[0], table[1 : 1 + STATES], table[1 + STATES :])
    else:
        flat = np.ones(STATES)
        model = Model(flat / STATES, np.ones((STATES, STATES)) / STATES, np.ones((lex.classes, STATES)))

    schema = f"doc_id {kind}, th long, held_out boolean, h long, n long, known long, base double, inner double"
    scored = store.written(rows.mapInArrow(_score(spark.sparkContext.broadcast((lex, model))), schema), "scored")
    rare = scored.where("h is not null").select("h", "doc_id", "th", "n").join(counts.select("h", F.col("n").alias("c")), "h", "left")
    log = F.log10(F.coalesce("c", F.lit(0)) + 0.5) * F.col("n")
    part = rare.groupBy("doc_id", "th").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("r_known"), F.sum(log).alias("r_log"))
    whole = scored.where("h is null")
    # equal rows have added up the same words each: their sums are divided by their number
    copies = whole.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.count("*").alias("m"))
    part = part.join(copies, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select("d", "t", (F.col("r_known") / F.col("m")).cast("long").alias("r_known"), (F.col("r_log") / F.col("m")).alias("r_log"))
    each = whole.join(part, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left")
    more = lambda c, r: F.col(c) + F.coalesce(r, F.lit(0))
    d = float(np.log10(n_all + 0.5 * (v_all + 1)))
    return each.select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), more("known", "r_known").alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (more("base", "r_log") - F.col("n") * F.lit(d)).alias("base_score"), more("inner", "r_log").alias("score"),
    )

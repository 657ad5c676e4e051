"""Toxicity by multiple-instance learning.

A text is a bag of sentences. A sentence has a logistic score over hashed words
and word beginnings; a text is toxic if any sentence is (noisy-or):
``P = 1 - prod(1 - p_s)``. Only texts are labelled; the gradient of the
noisy-or decides which sentences explain a label. The fit takes a bounded,
class-balanced sample of labelled texts; scoring is one map over whole texts,
and the sentence with the largest score locates the offence.

Defined results: null and empty texts have no sentence and get score 0; nothing
is learned without both classes (every score is then 0); a row whose key repeats
in the labels takes the largest label; a very long text is scored whole, at about 60
bytes a word; of sentences that score alike the first is the worst; repeated rows and
null keys score alike; an empty table gives no rows; other input columns, whatever
their names, are not carried along (``without_toxic`` keeps them all).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from . import text as tx

BITS = 18
#: Labelled texts of each class that the fit sees, about.
TRAIN_PER_CLASS = {1: 2500, 0: 5000}
PREFIX = 5
MIN_TEXTS = 2
MIN_LIFT = 3.0
STEPS = 250
RIDGE = 1e-5

#: ASCII bytes other than letters and digits separate words; . ! ? and line ends close a sentence.
APART = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
STOP = np.zeros(256, bool)
STOP[[33, 46, 63, 10]] = True
STOP_PATTERN = "[.!?\n]"


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, sentence) pairs, and the row and ordinal of each sentence.

    Sentence ids rise through the block. Each word gives two features, itself
    and its first PREFIX bytes.
    """
    starts, ends, rows = tx.spans(APART[buf], offs)
    stops = np.concatenate([[0], np.cumsum(STOP[buf])])
    ordinal = stops[starts] - stops[offs[rows]] if len(starts) else np.zeros(0, np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (ordinal[1:] != ordinal[:-1])
    sentence = np.cumsum(new) - 1
    sums = tx.byte_sums(buf)
    whole = tx.span_hashes(sums, starts, ends)
    begin = tx.span_hashes(sums, starts, np.minimum(ends, starts + PREFIX)) ^ np.uint64(0x5BD1E995)
    f = (tx.mix(np.concatenate([whole, begin])) >> np.uint64(64 - BITS)).astype(np.int32)
    return f, np.concatenate([sentence, sentence]), rows[new], ordinal[new]


def _bags(batches):
    """Each text's distinct (feature, sentence) pairs and its number of sentences."""
    for batch in batches:
        for part, buf, offs in tx.blocks(batch, "text"):
            f, s, row, ordinal = features(buf, offs)
            pairs = np.unique((s.astype(np.int64) << BITS) | f)
            s, f = pairs >> BITS, (pairs & ((1 << BITS) - 1)).astype(np.int32)
            cut = np.searchsorted(row[s] if len(s) else np.zeros(0), np.arange(part.num_rows + 1))
            yield pa.record_batch({
                "toxic": part.column("toxic"), "n": np.bincount(row, minlength=part.num_rows).astype(np.int64),
                "f": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(f)), "s": pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ordinal[s].astype(np.int32) if len(s) else np.zeros(0, np.int32))),
            })


def _chosen(mask):
    """Only the pairs of chosen features."""

    def run(batches):
        for batch in batches:
            f, s = (batch.column(c).flatten().to_numpy() for c in "fs")
            keep = mask.value[f]
            row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column("f").offsets.to_numpy()))[keep]
            cut = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.record_batch({"toxic": batch.column("toxic"), "n": batch.column("n"), "f": pa.ListArray.from_arrays(cut, pa.array(f[keep])), "s": pa.ListArray.from_arrays(cut, pa.array(s[keep]))})

    return run


def _softplus(z):
    return np.logaddexp(0.0, z)


class Bags:
    """Labelled texts as pairs (text, sentence, feature); the other of a text's ``sentences`` have the bias alone."""

    def __init__(self, label: np.ndarray, sentences: np.ndarray, text: np.ndarray, sentence: np.ndarray, feature: np.ndarray):
        self.label, self.n = label, len(label)
        self.names, self.col = np.unique(feature, return_inverse=True)
        where, self.inst = np.unique(text.astype(np.int64) << 32 | sentence, return_inverse=True)
        self.bag = where >> 32
        self.plain = sentences - np.bincount(self.bag, minlength=self.n)
        share = {x: max((label == x).sum(), 1) for x in (0, 1)}
        self.weight = np.where(label == 1, self.n / 2 / share[1], self.n / 2 / share[0])

    def loss(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray]:
        """Mean weighted negative log likelihood under the noisy-or, with a small ridge, and its gradient by w and b."""
        z = b + np.bincount(self.inst, weights=w[self.col], minlength=len(self.bag))
        total = np.bincount(self.bag, weights=_softplus(z), minlength=self.n) + self.plain * _softplus(b)
        total = np.clip(total, 1e-9, 50)
        each = np.where(self.label == 1, -np.log(-np.expm1(-total)), total)
        g = self.weight * np.where(self.label == 1, -1.0 / np.expm1(total), 1.0) / self.n
        gz = g[self.bag] / (1 + np.exp(-z))
        by_w = np.bincount(self.col, weights=gz[self.inst], minlength=len(self.names)) + RIDGE * w
        return float((self.weight * each).mean() + RIDGE / 2 * (w @ w)), np.append(by_w, gz.sum() + (g * self.plain).sum() / (1 + np.exp(-b)))


def learn(*bags) -> tuple[np.ndarray, np.ndarray, float]:
    """Features, their weights and the bias, by Adam from zero weights."""
    data = Bags(*bags)
    x = np.append(np.zeros(len(data.names)), -6.0)
    m, v = np.zeros(len(x)), np.zeros(len(x))
    for step in range(1, STEPS + 1):
        grad = data.loss(x[:-1], x[-1])[1]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        x = x - 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return data.names, x[:-1], float(x[-1])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", per_class: dict[int, int] = TRAIN_PER_CLASS) -> tuple[np.ndarray, float] | None:
    """Feature weights and bias, or None if a class is missing.

    The sample holds about ``per_class`` texts of each class, drawn by a hash
    of the key; copies of a text count once.
    """
    y = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("toxic"))
    sizes = dict(y.groupBy("toxic").count().collect())
    if not sizes.get(0) or not sizes.get(1):
        return None
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, per_class[1] / sizes[1]))).otherwise(F.lit(min(1.0, per_class[0] / sizes[0])))
    drawn = F.pmod(F.xxhash64(F.col("k"), F.lit("toxicity")), F.lit(1 << 30)) < share * (1 << 30)
    # the drawn keys are bounded by per_class
    sample = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(y.where(drawn)), "k")
    once = sample.groupBy(F.xxhash64("text").alias("h")).agg(F.max("toxic").alias("toxic"), F.min(F.lower("text")).cast("binary").alias("text"))
    bags = store.written(once.select("toxic", "text").mapInArrow(_bags, "toxic int, n long, f array<int>, s array<int>"), "bags")
    # features that toxic texts have clearly more often; the others weigh nothing
    texts = {r.toxic: r.n for r in bags.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(texts) < 2:
        return None
    seen = bags.select("toxic", F.explode(F.array_distinct("f")).alias("f")).groupBy("f").agg(F.sum("toxic").alias("p"), F.count("*").alias("m"))
    lift = ((F.col("p") + 0.1) / texts[1]) / ((F.col("m") - F.col("p") + 0.1) / texts[0])
    chosen = np.zeros(1 << BITS, bool)
    chosen[seen.where((F.col("p") >= MIN_TEXTS) & (lift >= MIN_LIFT)).select("f").toArrow()["f"].to_numpy()] = True
    few = bags.mapInArrow(_chosen(docs.sparkSession.sparkContext.broadcast(chosen)), bags.schema).toArrow()
    store.drop(docs.sparkSession, bags)
    label_of, sentences = few["toxic"].to_numpy(), few["n"].to_numpy()
    f, s = (np.concatenate([np.zeros(0, np.int32), *(x.flatten().to_numpy() for x in few[c].chunks)]) for c in "fs")
    d = np.repeat(np.arange(len(label_of)), np.concatenate([np.diff(x.offsets.to_numpy()) for x in few["f"].chunks]))
    names, w, b = learn(label_of, sentences, d, s, f)
    weights = np.zeros(1 << BITS, np.float32)
    weights[names] = w
    return weights, float(b)


def _score(model):
    def run(batches):
        weights, bias = model.value
        for batch in batches:
            for part, buf, offs in tx.blocks(batch, "text"):
                f, s, row, ordinal = features(buf, offs)
                n = part.num_rows
                # a feature counts once a sentence, as in the fit
                hit = np.flatnonzero(weights[f])
                pairs = np.unique((s[hit].astype(np.int64) << BITS) | f[hit])
                z = bias + np.bincount(pairs >> BITS, weights=weights[pairs & ((1 << BITS) - 1)], minlength=len(row))
                total = np.bincount(row, weights=_softplus(z), minlength=n)
                worst, top = np.full(n, -1, np.int32), np.zeros(n)
                if len(row):
                    by = np.lexsort((-ordinal, z, row))
                    last = by[np.flatnonzero(np.r_[row[by][1:] != row[by][:-1], True])]
                    worst[row[last]] = ordinal[last]
                    top[row[last]] = 1 / (1 + np.exp(-z[last]))
                score = -np.expm1(-total)
                yield pa.record_batch({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "score": score, "predicted": (score >= 0.5).astype(np.int32), "worst_sentence": worst, "worst_score": top})

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, text: str = "text", key: str = "doc_id", held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted, worst_sentence, worst_score) for every row; no shuffle.

    ``worst_sentence`` counts the pieces between STOP_PATTERN matches from 0; -1 if there is none.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    out = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    rows = docs.select(F.col(key).alias("doc_id"), out.alias("held_out"), F.lower(F.col(text)).cast("binary").alias("text"))
    model = model or (np.zeros(1 << BITS, np.float32), -np.inf)
    return rows.mapInArrow(_score(spark.sparkContext.broadcast(model)), f"doc_id {kind}, held_out boolean, score double, predicted int, worst_sentence int, worst_score double")


def _flag(model):
    def run(batches):
        for batch in batches:
            parts = list(_score(model)(iter([batch.select(["text"]).append_column("doc_id", pa.nulls(batch.num_rows, pa.int64())).append_column("held_out", pa.nulls(batch.num_rows, pa.bool_()))])))
            clean = pa.concat_arrays([p.column("predicted") for p in parts]).to_numpy() == 0 if parts else np.zeros(0, bool)
            yield batch.drop_columns(["text"]).filter(pa.array(clean))

    return run


def without_toxic(docs: DataFrame, model: tuple[np.ndarray, float] | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text isn't predicted toxic, with all their columns; no shuffle."""
    if model is None:
        return docs
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(docs.columns, names)), F.lower(F.col(text)).cast("binary").alias("text"))
    kept = rows.mapInArrow(_flag(docs.sparkSession.sparkContext.broadcast(model)), rows.drop("text").schema)
    return kept.toDF(*docs.columns)


def offending(docs: DataFrame, scores: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The worst sentence of each text predicted toxic: (doc_id, sentence, worst_score)."""
    hits = scores.where("predicted = 1").select("doc_id", "worst_sentence", "worst_score")
    return docs.join(hits, docs[key].eqNullSafe(hits["doc_id"])).select(hits["doc_id"], F.trim(F.get(F.split(docs[text], STOP_PATTERN), F.col("worst_sentence"))).alias("sentence"), "worst_score")

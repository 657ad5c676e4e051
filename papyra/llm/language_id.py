"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed 1- to 3-grams of labelled texts in each partition
and sums them by (language, bucket): at most languages x BUCKETS rows reach the
driver. The log-probability matrix is broadcast; scoring gathers its rows for
the n-grams of a block of texts and sums them per text in numpy.

Characters are lower-cased; everything that is not a letter is a word border.
Defined results: a text that is null or has no letter is ``und`` with score 0
(so is every text if nothing could be learned); equal posteriors go to the
language that comes first by code point; a very long text is predicted whole, at
about 40 bytes a character; repeated rows and null keys are predicted alike; an
empty table gives no rows; more than MAX_LANGUAGES labels are an error, since the
matrix would have no bound; other input columns, whatever their names, are not
carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx

#: Size of the hashed feature space.
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Texts of one language that are learned from, about: the fit's sample bound.
TRAIN_PER_LANGUAGE = 4000
SMOOTHING = 0.5
#: The matrix that is broadcast has at most BUCKETS x MAX_LANGUAGES entries.
MAX_LANGUAGES = 256

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def characters(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points with one blank for every run of non-letters, and their rows."""
    raw = buf.tobytes()
    cps = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    heads = np.flatnonzero((buf & 0xC0) != 0x80)
    if len(heads) == len(cps):
        rows = np.searchsorted(offs[1:], heads, "right")
    else:  # invalid UTF-8: decode row by row
        parts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offs, offs[1:])]
        cps = np.frombuffer("".join(parts).encode("utf-32-le", "replace"), np.uint32)
        rows = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    letter = letter_table()[cps]
    cps = np.where(letter, cps, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1] | (rows[1:] != rows[:-1])
    keep[:1] = True
    return cps[keep], rows[keep]


def grams(cps: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of the n-grams of each order that lie within a row."""
    c = cps.astype(np.uint64)
    for n in ORDERS:
        m = len(c) - n + 1
        if m <= 0:
            return
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + c[k : m + k]
        inside = rows[:m] == rows[n - 1 :]
        at = (tx.mix(h) >> np.uint64(48)).astype(np.int32)
        yield at[inside], rows[:m][inside]


def _count(langs: list[str]):
    order = {x: i for i, x in enumerate(langs)}

    def run(batches):
        counts = np.zeros(len(langs) * BUCKETS, np.int64)
        for batch in batches:
            for part, buf, offs in tx.blocks(batch, "text"):
                lang = np.array([order[x] for x in part.column("lang").to_pylist()], np.int64)
                for at, rows in grams(*characters(buf, offs)):
                    counts += np.bincount(lang[rows] * BUCKETS + at, minlength=len(counts))
        got = np.flatnonzero(counts)
        yield pa.record_batch({"cell": got, "n": counts[got]})

    return run


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = TRAIN_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages and the (BUCKETS + 1, languages) log matrix; its last row is the prior.

    Of a language with more than ``per_language`` texts, those are learned from
    whose hashed key falls below the share that makes about that many.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = dict(known.groupBy(F.col(lang).alias("l")).count().limit(MAX_LANGUAGES + 1).collect())
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((BUCKETS + 1, 0))
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    shares = F.create_map(*(F.lit(y) for x in langs for y in (x, min(1.0, per_language / sizes[x]))))
    share = F.element_at(shares, F.col(lang))
    drawn = F.pmod(F.xxhash64(F.col(key), F.lit("language")), F.lit(1 << 30)) < share * (1 << 30)
    sample = known.where(drawn).select(F.col(lang).alias("lang"), F.lower(F.col(text)).cast("binary").alias("text"))
    cells = sample.mapInArrow(_count(langs), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(langs), BUCKETS))
    counts.reshape(-1)[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    counts += SMOOTHING
    prior = np.array([sizes[x] for x in langs], float)
    rows = np.log(counts / counts.sum(1, keepdims=True)).T
    return langs, np.vstack([rows, np.log(prior / prior.sum())])


def _score(model):
    def run(batches):
        langs, matrix = model.value
        weights, prior = np.ascontiguousarray(matrix[:-1], np.float32), matrix[-1]
        for batch in batches:
            for part, buf, offs in tx.blocks(batch, "text"):
                n = part.num_rows
                total = np.tile(prior, (n, 1))
                for at, rows in grams(*characters(buf, offs)):
                    if len(rows):
                        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                        total[rows[first]] += np.add.reduceat(weights[at], first, axis=0, dtype=np.float64)
                p = np.exp(total - total.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                some = part.column("letters").to_numpy(zero_copy_only=False)
                best = p.argmax(1)
                pred = [langs[b] if s else "und" for b, s in zip(best, some)]
                yield pa.record_batch({"doc_id": part.column("doc_id"), "held_out": part.column("held_out"), "lang_pred": pa.array(pred, pa.string()), "score": np.where(some, np.clip(p[np.arange(n), best], 0.0, 1.0), 0.0)})

    return run


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", key: str = "doc_id", held_out: Column | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row, in one pass without a shuffle."""
    spark, (langs, matrix) = docs.sparkSession, model
    out = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)) if langs else F.lit(False)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), out.alias("held_out"), letters.alias("letters"), F.lower(F.col(text)).cast("binary").alias("text"))
    if not langs:
        langs, matrix = ["und"], np.zeros((BUCKETS + 1, 1))
    return rows.mapInArrow(_score(spark.sparkContext.broadcast((langs, matrix))), f"doc_id {kind}, held_out boolean, lang_pred string, score double")

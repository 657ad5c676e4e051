"""Models that texts and images are run through: encoders, embeddings, taggers, OCR.

A model is made once a worker by a factory the caller gives; rows stream through it in
mini-batches of like length. Nothing here downloads or names a model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.functions import measures
from papyra.operators import batching

#: Texts in a mini-batch, and tokens that an encoder reads of a text.
BATCH, LENGTH = 16, 512
#: Fixed value: dollars per million tokens of the vision model, in and out.
VISION_PRICE = 0.15

_models: dict = {}


def once(factory: Callable):
    """What a factory makes, made once in each worker."""
    key = (factory.__module__, factory.__qualname__)
    if key not in _models:
        _models[key] = factory()
    return _models[key]


def embeddings(docs: DataFrame, factory: Callable[[], Callable[[list[str]], np.ndarray]], key: str = "doc_id", text: str = "text", prefix: str = "", batch: int = BATCH) -> DataFrame:
    """(key, embedding): ``factory`` makes a function of a list of texts to rows of numbers; ``prefix`` goes before each text."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = once(factory)
        for pdf in batches:
            rows = batching.length_sorted([prefix + (t or "") for t in pdf[text]], batch, lambda x: list(np.asarray(encode(x), np.float32)))
            yield pd.DataFrame({key: pdf[key], "embedding": rows})

    return docs.select(key, text).mapInPandas(run, f"`{key}` {kind}, embedding array<float>")


def classified(docs: DataFrame, factory: Callable[[], tuple[Callable, Callable, list[str]]], key: str = "doc_id", text: str = "text", batch: int = BATCH, length: int = LENGTH) -> DataFrame:
    """(key, n_words, n_tokens, encoded_share, label, score, second, second_score) by an encoder.

    ``factory`` makes (scores of a list of texts as logits, number of tokens of a text,
    labels). A softmax gives the two best labels, ties to the first; the share is what the
    encoder reads of a text.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        logits, count, labels = once(factory)

        def best(texts: list[str]) -> list[tuple]:
            z = np.asarray(logits(texts), float)
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            order = np.argsort(-p, axis=1, kind="stable")[:, :2]
            return [(labels[i], round(float(q[i]), 4), labels[j], round(float(q[j]), 4)) for q, (i, j) in zip(p, order)]

        for pdf in batches:
            texts = [t or "" for t in pdf[text]]
            tokens = [count(t) for t in texts]
            found = pd.DataFrame(batching.length_sorted(texts, batch, best), columns=["label", "score", "second", "second_score"])
            share = [round(min(1.0, length / max(n, 1)), 3) for n in tokens]
            yield pd.DataFrame({key: pdf[key].to_numpy(), "n_words": [len(t.split()) for t in texts], "n_tokens": tokens, "encoded_share": share}).join(found)

    return docs.select(key, text).mapInPandas(run, f"`{key}` {kind}, n_words long, n_tokens long, encoded_share double, label string, score double, second string, second_score double")


def lemmas(docs: DataFrame, factory: Callable[[], Callable[[str], list[tuple[str, str]]]], categories: tuple[str, ...], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tokens): lower-case lemmas of words of the given categories that are letters only; a tagger gives (lemma, category)."""
    kind = docs.schema[key].dataType.simpleString()
    wanted = set(categories)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tag = once(factory)
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "tokens": [[w.lower() for w, c in tag(t or "") if c in wanted and w.isalpha()] for t in pdf[text]]})

    return docs.select(key, text).mapInPandas(run, f"`{key}` {kind}, tokens array<string>")


def transcribed(page_blocks: DataFrame, factory: Callable[[], Callable[[bytes], tuple[str, int, int]]], keep: list[str], crop: str = "crop", text: str = "text") -> DataFrame:
    """(keep, text_new, text_old, is_title, error, prompt_tokens, completion_tokens): blocks read anew from their crops.

    ``factory`` makes a reader of an image's bytes that returns its text and the tokens
    used. Titles, and blocks without an image, are copied; a block whose reader fails keeps
    its text and says why.
    """
    kinds = {f.name: f.dataType.simpleString() for f in page_blocks.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = once(factory)
        for pdf in batches:
            out = []
            for old, image, title in zip(pdf[text], pdf[crop], pdf["is_title"]):
                row = [old, old, bool(title), None, 0, 0]
                if not title and image is not None:
                    try:
                        new, row[4], row[5] = read(image)
                        row[0] = new.strip()
                    except Exception as e:  # any failure of a service or an engine is the block's own
                        row[3] = str(e)[:200] or type(e).__name__
                out.append(row)
            yield pdf[keep].reset_index(drop=True).join(pd.DataFrame(out, columns=["text_new", "text_old", "is_title", "error", "prompt_tokens", "completion_tokens"]))

    names = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return page_blocks.select(*keep, text, crop, "is_title").mapInPandas(run, f"{names}, text_new string, text_old string, is_title boolean, error string, prompt_tokens long, completion_tokens long")


def running_cost(log: DataFrame, by: list[str] | None = None, price: float = VISION_PRICE) -> DataFrame:
    """Tokens and dollars of a transcription log, in all or by columns."""
    used = (F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    per = log.groupBy(*(by or [])).agg(*used, F.count("error").alias("n_errors"))
    return per.withColumn("cost", (F.col("prompt_tokens") + F.col("completion_tokens")) / F.lit(1e6) * F.lit(price))


def aligned(page_blocks: DataFrame, found: DataFrame, keep: list[str], wide: float = 400.0, high: float = 200.0) -> DataFrame:
    """(keep, block_id, text, iou): for each block the text of the found box that overlaps it best, or its own.

    ``page_blocks`` and ``found``: boxes l, t, r, b, with block_id and text; boxes of a page
    meet in cells of about a block's size only.
    """
    line = lambda lo, hi, step: F.sequence(F.floor(F.col(lo) / step), F.floor(F.col(hi) / step))
    box = F.struct(*(F.col(c).cast("double").alias(c) for c in "ltrb"))
    cell = lambda df, *c: df.select(*keep, *c, F.explode(line("l", "r", wide)).alias("_x"), line("t", "b", high).alias("_ys")).withColumn("_y", F.explode("_ys")).drop("_ys")
    left, right = cell(page_blocks, "block_id", box.alias("p")), cell(found, F.col("text").alias("new"), box.alias("q"))
    side = lambda c: {k: F.col(f"{c}.{k}") for k in "ltrb"}
    met = left.join(right, [*keep, "_x", "_y"]).select(*keep, "block_id", "new", measures.iou(side("p"), side("q")).alias("iou")).where("iou > 0")
    best = met.groupBy(*keep, "block_id").agg(F.max(F.struct("iou", "new")).alias("m"))
    return page_blocks.join(best, [*keep, "block_id"], "left").select(*keep, "block_id", F.coalesce("m.new", "text").alias("text"), F.coalesce("m.iou", F.lit(0.0)).alias("iou"))

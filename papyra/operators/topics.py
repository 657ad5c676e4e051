"""Topic measures over (topic, word) lists and (doc, word) corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyra import store
from papyra.functions import measures

TOP = 10


def counted(texts: DataFrame, words: str = "words", *keys: str) -> DataFrame:
    """(keys, word, n): how often each word stands in each text, written once and read by all that follows.

    Words are summed where they are read, and what is shuffled is a text's distinct words.
    """
    each = texts.select(*keys, F.explode(words).alias("word")).groupBy(*keys, "word").agg(F.count("*").alias("n"))
    return store.written(each, "words")


def frequencies(words: DataFrame, group: str) -> DataFrame:
    """(group, word, n) of counted words."""
    return words.groupBy(group, "word").agg(F.sum("n").alias("n"))


def top_words(words: DataFrame, group: str, k: int = TOP) -> DataFrame:
    """(group, word, n, rank): the k most frequent of counted words; ties by word.

    Summed before ranking, so only distinct words meet in the window.
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "word"))
    return frequencies(words, group).withColumn("rank", rank).where(F.col("rank") <= k)


def non_empty(topics: DataFrame, words: str = "top_words") -> DataFrame:
    """Topics that have a top word at all."""
    return topics.where(F.size(F.filter(words, lambda w: F.trim(w) != "")) > 0)


def npmi(topics: DataFrame, corpus: DataFrame, n_docs: int, digits: int = 4) -> DataFrame:
    """(topic, npmi): the mean over all pairs of a topic's words, rounded; 0 for a topic of one word.

    The corpus (doc, word), each word once a document, is cut to topic words before
    pairs are formed; pairs come from a document's own word set, so no words of
    different documents meet. ``n_docs`` counts all documents.
    """
    vocab = topics.select("word").distinct()
    seen = corpus.join(vocab, "word", "left_semi").groupBy("doc").agg(F.sort_array(F.collect_set("word")).alias("ws"))
    seen = store.written(seen, "seen")
    single = seen.select(F.explode("ws").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    rest = F.expr("flatten(transform(ws, (a, i) -> transform(slice(ws, i + 2, size(ws)), b -> named_struct('w1', a, 'w2', b))))")
    pairs = topics.select("topic", F.col("word").alias("w1")).join(topics.select("topic", F.col("word").alias("w2")), "topic").where("w1 < w2")
    wanted = pairs.select("w1", "w2").distinct()
    both = seen.select(F.explode(rest).alias("p")).select("p.*").groupBy("w1", "w2").agg(F.count("*").alias("n12")).join(wanted, ["w1", "w2"], "left_semi")
    at = pairs.join(single.toDF("w1", "n1"), "w1", "left").join(single.toDF("w2", "n2"), "w2", "left").join(both, ["w1", "w2"], "left")
    value = measures.npmi(F.col("n1"), F.col("n2"), F.col("n12"), F.lit(n_docs))
    mean = at.groupBy("topic").agg(F.bround(F.avg(value), digits).alias("npmi"))
    return topics.select("topic").distinct().join(mean, "topic", "left").select("topic", F.coalesce("npmi", F.lit(0.0)).alias("npmi"))


def diversity(topics: DataFrame) -> DataFrame:
    """Distinct share of the topics' words, distinct words, all words, and words of several topics."""
    per = topics.groupBy("word").agg(F.count("*").alias("n"))
    return per.agg((F.count("*") / F.sum("n")).alias("diversity"), F.count("*").alias("unique_words"), F.sum("n").alias("total"), F.count_if(F.col("n") > 1).alias("n_shared"))


def ctfidf(words: DataFrame, group: str, k: int = TOP) -> DataFrame:
    """(group, rank, word, score): tf within the class times ln(1 + A / f), A the mean words of a class; of counted words."""
    tf = store.written(frequencies(words, group), "tf")
    f = tf.groupBy("word").agg(F.sum("n").alias("f"))
    sizes = tf.groupBy(group).agg(F.sum("n").alias("size"))
    mean = sizes.agg(F.avg("size").alias("mean"))
    scored = tf.join(f, "word").join(sizes, group).crossJoin(F.broadcast(mean)).withColumn("score", F.col("n") / F.col("size") * F.ln(1 + F.col("mean") / F.col("f")))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(F.round("score", 12)), "word"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(group, "rank", "word", "score")


def common(words: DataFrame, min_df: int, doc: str = "doc_id") -> DataFrame:
    """Counted words that stand in ``min_df`` documents or more."""
    df = words.groupBy("word").agg(F.countDistinct(doc).alias("_df")).where(F.col("_df") >= min_df).select("word")
    return words.join(df, "word", "left_semi")


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, jaccard) of the topics (topic, word) of two runs that share a word; they meet by word."""
    size = lambda t, n: t.groupBy(F.col("topic").alias(n)).agg(F.countDistinct("word").alias(f"n_{n}"))
    met = a.select(F.col("topic").alias("a"), "word").distinct().join(b.select(F.col("topic").alias("b"), "word").distinct(), "word")
    both = met.groupBy("a", "b").agg(F.count("*").alias("n")).join(size(a, "a"), "a").join(size(b, "b"), "b")
    return both.select("a", "b", (F.col("n") / (F.col("n_a") + F.col("n_b") - F.col("n"))).alias("jaccard"))


def stability(a: DataFrame, b: DataFrame, most: int = 500) -> list[tuple]:
    """(a, b, jaccard): topics of two runs matched one to one by falling overlap, ties by name.

    For runs of at most ``most`` topics each; topics without a partner are left out.
    """
    for run in (a, b):
        if run.select("topic").distinct().limit(most + 1).count() > most:
            raise ValueError(f"more than {most} topics in a run")
    used_a, used_b, out = set(), set(), []
    for r in overlaps(a, b).orderBy(F.desc("jaccard"), "a", "b").collect():
        if r.a not in used_a and r.b not in used_b:
            used_a.add(r.a)
            used_b.add(r.b)
            out.append((r.a, r.b, r.jaccard))
    return out

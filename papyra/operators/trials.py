"""Blind trials: drawing items, decoys, and scoring."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra import store
from papyra.operators import ranking


def lot(seed: str, *keys: str) -> Column:
    """A reproducible random order: md5 of the seed and the keys."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.col(k).cast("string") for k in keys)))


def quota(items: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """Up to n items of each stratum, in random order.

    Each of 64 parts of a stratum gives its first n before they meet, so a large
    stratum is no single task's work.
    """
    rows = items.withColumn("_lot", lot(seed, key)).withColumn("_part", F.pmod(F.xxhash64(key), F.lit(64)))
    for by in ([stratum, "_part"], [stratum]):
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_lot", key))).where(F.col("_r") <= n)
    return rows.drop("_lot", "_part", "_r")


def decoys(uses: DataFrame, bands: DataFrame, seed: str) -> DataFrame:
    """(article, decoy): a label of the band of the article's least label, not its own; null if none.

    Each band's labels stand in one circle by lot. An article begins at a place
    by its own lot and takes the first label that it doesn't have, which is among
    as many places as it has labels in the band, and one more.
    """
    own = uses.join(bands, "label")
    article = own.groupBy("article").agg(F.min_by("band", "label").alias("band"))
    order = [F.col("_lot"), F.col("label")]
    placed = ranking.cumulative(bands.withColumn("_lot", lot(seed, "label")).withColumn("_one", F.lit(1)), ["band"], order, "_one")
    placed = placed.select("band", "label", (F.col("rank") - 1).cast("int").alias("place"))
    size = bands.groupBy("band").agg(F.count("*").cast("int").alias("size"))
    mine = own.groupBy("article", "band").agg(F.count("*").cast("int").alias("mine"))
    start = F.pmod(F.conv(F.substring(lot(seed, "article"), 1, 15), 16, 10).cast("long"), F.col("size")).cast("int")
    some = article.join(mine, ["article", "band"]).join(size, "band").withColumn("start", start)
    tried = some.select("article", "band", "size", "start", F.explode(F.sequence(F.lit(0), F.least(F.col("mine"), F.col("size") - 1))).alias("step"))
    tried = tried.withColumn("place", (F.col("start") + F.col("step")) % F.col("size")).join(placed, ["band", "place"]).join(uses, ["article", "label"], "left_anti")
    pick = tried.groupBy("article").agg(F.min_by("label", "step").alias("decoy"))
    return article.select("article").join(pick, "article", "left")


def kit(uses: DataFrame, bands: DataFrame, n_items: int, seed: str) -> DataFrame:
    """(item, article, label, is_true, band): a blind trial of about ``n_items`` items.

    Bands, by an article's least label, share the items evenly. A coin decides whether
    an item shows one of the article's own labels, drawn by lot, or a decoy; an article
    whose coin wants a decoy that there isn't gives no item. Items are numbered in a
    random order.
    """
    own = uses.join(bands, "label")
    article = own.groupBy("article").agg(F.min_by("band", "label").alias("band"))
    n_bands = article.select("band").distinct().count()
    drawn = store.written(quota(article, "band", "article", n_items // max(n_bands, 1), seed), "drawn")
    mine = uses.join(drawn.select("article"), "article", "left_semi")
    true = mine.groupBy("article").agg(F.min_by("label", lot(seed + "t", "article", "label")).alias("own"))
    coin = F.conv(F.substring(lot(seed + "c", "article"), 1, 1), 16, 10).cast("int") % 2 == 0
    both = drawn.join(true, "article").join(decoys(mine, bands, seed), "article").withColumn("is_true", coin)
    shown = both.withColumn("label", F.when(F.col("is_true"), F.col("own")).otherwise(F.col("decoy"))).where("label IS NOT NULL")
    number = F.row_number().over(Window.orderBy(lot(seed + "o", "article"), "article"))  # n_items rows at most
    return shown.select(F.format_string("B%03d", number).alias("item"), "article", "label", "is_true", "band")


def intrusion(top: DataFrame, seed: str, shown: int = 5, offered: int = 5) -> DataFrame:
    """(topic, words, intruder, position): ``shown`` of a topic's words by lot and one of another topic's first ``offered``.

    ``top``: (topic, word, rank). The intruder is none of the topic's own words; it is
    drawn by ``decoys``, so no topic meets all words. Words stand in random order.
    """
    uses = top.select(F.col("topic").alias("article"), F.col("word").alias("label"))
    pool = top.where(F.col("rank") <= offered).select(F.col("word").alias("label"), F.lit("all").alias("band")).distinct()
    foreign = decoys(uses.join(pool.select("label"), "label", "left_semi"), pool, seed).select(F.col("article").alias("topic"), F.col("decoy").alias("intruder")).where("intruder IS NOT NULL")
    mine = F.row_number().over(Window.partitionBy("topic").orderBy(lot(seed + "w", "topic", "word"), "word"))
    kept = top.withColumn("_r", mine).where(F.col("_r") <= shown).select("topic", "word")
    every = kept.join(foreign.select("topic"), "topic", "left_semi").union(foreign.select("topic", F.col("intruder").alias("word")))
    place = F.row_number().over(Window.partitionBy("topic").orderBy(lot(seed + "p", "topic", "word"), "word"))
    lines = every.withColumn("_p", place).join(foreign, "topic").groupBy("topic", "intruder").agg(F.sort_array(F.collect_list(F.struct("_p", "word"))).alias("l"))
    words = F.transform("l", lambda x: x["word"])
    return lines.select("topic", words.alias("words"), "intruder", F.array_position(words, F.col("intruder")).cast("int").alias("position"))


def nmi(table: DataFrame, a: str, b: str, n: str = "n") -> DataFrame:
    """n, entropies, mutual information and NMI = 2 I / (Ha + Hb) of a contingency table."""
    total = table.agg(F.sum(n).alias("t"))
    left, right = table.groupBy(a).agg(F.sum(n).alias("x")), table.groupBy(b).agg(F.sum(n).alias("y"))
    plogp = lambda c: -F.sum(F.col(c) / F.col("t") * F.ln(F.col(c) / F.col("t")))
    h = lambda df, c, name: df.crossJoin(F.broadcast(total)).agg(plogp(c).alias(name))
    term = F.col(n) / F.col("t") * F.ln(F.col(n) * F.col("t").cast("double") / (F.col("x") * F.col("y")))
    mi = table.join(left, a).join(right, b).crossJoin(F.broadcast(total)).agg(F.sum(term).alias("mi"), F.max("t").alias("n"))
    out = mi.crossJoin(F.broadcast(h(left, "x", "h_a"))).crossJoin(F.broadcast(h(right, "y", "h_b")))
    r = lambda c: F.round(c, 9)
    return out.select("n", r("h_a").alias("h_a"), r("h_b").alias("h_b"), r("mi").alias("mi"), r(2 * F.col("mi") / (F.col("h_a") + F.col("h_b"))).alias("nmi"))


def two_proportions(rows: DataFrame, first: Column, yes: Column) -> DataFrame:
    """The z of the difference of two groups' shares."""
    g = rows.agg(F.count_if(first).cast("double").alias("n1"), F.count_if(~first).cast("double").alias("n2"), F.avg(F.when(first, yes)).alias("p1"), F.avg(F.when(~first, yes)).alias("p2"))
    p = (F.col("p1") * F.col("n1") + F.col("p2") * F.col("n2")) / (F.col("n1") + F.col("n2"))
    return g.select(F.round((F.col("p1") - F.col("p2")) / F.sqrt(p * (1 - p) * (1 / F.col("n1") + 1 / F.col("n2"))), 9).alias("z"))


def _small(table: list[tuple], most: int) -> tuple[dict, list, list]:
    """Cells by pair, and both sides' groups by falling size, ties by name."""
    cells, left, right = {(a, b): n for a, b, n in table}, Counter(), Counter()
    for (a, b), n in cells.items():
        left[a] += n
        right[b] += n
    if max(len(left), len(right)) > most:
        raise ValueError(f"matching is for at most {most} groups a side")
    fall = lambda c: sorted(c, key=lambda x: (-c[x], x))
    return cells, fall(left), fall(right)


def match_groups(table: list[tuple], most: int = 60) -> dict:
    """For each group of the second side, one of the first: by falling size, each takes the free one that it shares most with.

    When none is free, groups of the first side serve again, in their order. Noise
    (negative numbers) is left out. For a collected table (a, b, n) of at most most x most cells.
    """
    cells, left, right = _small([r for r in table if r[0] >= 0 and r[1] >= 0], most)
    free, out = list(left), {}
    for b in right:
        if free:
            out[b] = max(free, key=lambda a: cells.get((a, b), 0))
            free.remove(out[b])
        else:
            out[b] = left[len(out) % len(left)]
    return out


def diagonal_order(table: list[tuple], most: int = 60) -> tuple[list, list]:
    """Rows by falling size, and columns so that each row's best free column stands on the diagonal; the others follow by size."""
    cells, rows, free = _small(table, most)
    columns = []
    for a in rows:
        if not free:
            break
        columns.append(max(free, key=lambda b: cells.get((a, b), 0)))
        free.remove(columns[-1])
    return rows, columns + free

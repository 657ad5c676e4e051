"""Queries over vectors, time series, boxes, merges and runs; and those without SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyra import store
from papyra.functions import measures as M
from papyra.functions import text as X
from papyra.operators import labelling, learning, neighbours, trials
from papyra.streaming import windows

from .labels import JOINED, confusion_matrix
from .registry import query


def _dims(t):
    return t.embeddings.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS topic_id FROM embeddings")
def dominant_topic(t):
    return t.embeddings.select("vec_id", M.argmax(F.col("embedding")).alias("topic_id"))


@query("WITH d AS (SELECT list_position(embedding, list_max(embedding)) - 1 AS t FROM embeddings) SELECT r::INT AS topic_id, (SELECT count(*) FROM d WHERE t = r) AS n FROM (SELECT unnest(range(0, 64)) AS r)")
def topic_sizes(t):
    """Topics without documents keep a zero."""
    n = dominant_topic(t).groupBy("topic_id").agg(F.count("*").alias("n"))
    return t.spark.range(64).select(F.col("id").cast("int").alias("topic_id")).join(n, "topic_id", "left").select("topic_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("WITH s AS (SELECT vec_id, list_reverse_sort(list_transform(embedding, lambda x: x::DOUBLE)) AS s FROM embeddings) SELECT vec_id, round(s[1], 9) AS first, round(s[2], 9) AS second, round(s[1] - s[2], 9) AS margin FROM s")
def top2_margin(t):
    s = F.sort_array("v", asc=False)
    return _dims(t).select("vec_id", s[0].alias("a"), s[1].alias("b")).select("vec_id", F.round("a", 9).alias("first"), F.round("b", 9).alias("second"), F.round(F.col("a") - F.col("b"), 9).alias("margin"))


@query("WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * x) AS q FROM embeddings), p AS (SELECT vec_id, list_transform(q, lambda x: x / list_sum(q)) AS p FROM q), h AS (SELECT vec_id, list_sum(list_transform(list_filter(p, lambda x: x > 0), lambda x: -x * ln(x))) AS h FROM p) SELECT vec_id, round(h, 9) AS entropy, round(h / ln(64), 9) AS normalised FROM h")
def topic_entropy(t):
    squares = _dims(t).select("vec_id", F.transform("v", lambda x: x * x).alias("q")).withColumn("s", F.aggregate("q", F.lit(0.0), lambda a, x: a + x))
    h = squares.select("vec_id", M.entropy(F.transform("q", lambda x: x / F.col("s"))).alias("h"))
    return h.select("vec_id", F.round("h", 9).alias("entropy"), F.round(F.col("h") / F.ln(F.lit(64.0)), 9).alias("normalised"))


_BUCKET = "SELECT ((day(ts) - 1) // 5)::INT AS bucket, event_type AS topic, count(*) AS n FROM events GROUP BY 1, 2"


def _buckets(t):
    return t.events.groupBy(F.floor((F.dayofmonth("ts") - 1) / 5).cast("int").alias("bucket"), F.col("event_type").alias("topic")).agg(F.count("*").alias("n"))


@query(f"SELECT bucket, topic, n, (100.0::DOUBLE * n / sum(n) OVER (PARTITION BY bucket))::DOUBLE AS pct, round_even(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY bucket), 1)::DOUBLE AS pct_rounded FROM ({_BUCKET})")
def composition_by_period(t):
    pct = F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy("bucket"))
    return _buckets(t).select("bucket", "topic", "n", pct.alias("pct"), F.bround(pct, 1).alias("pct_rounded"))


@query(f"SELECT bucket, topic, (sum(n) OVER w - n)::BIGINT AS base, (sum(n) OVER w)::BIGINT AS top FROM ({_BUCKET}) WINDOW w AS (PARTITION BY bucket ORDER BY topic)")
def stacked_cumulative(t):
    top = F.sum("n").over(Window.partitionBy("bucket").orderBy("topic"))
    return _buckets(t).select("bucket", "topic", (top - F.col("n")).alias("base"), top.alias("top"))


@query("""
WITH d AS (SELECT day(ts)::INT AS x, count(*) FILTER (event_type = 'view') - count(*) FILTER (event_type = 'click') AS diff FROM events GROUP BY 1),
l AS (SELECT x AS x1, lead(x) OVER (ORDER BY x) AS x2, diff, lead(diff) OVER (ORDER BY x) AS nxt FROM d) SELECT x1, x2 FROM l WHERE diff * nxt < 0""")
def curve_crossing(t):
    d = t.events.groupBy(F.dayofmonth("ts").alias("x1")).agg((F.count_if(F.col("event_type") == "view") - F.count_if(F.col("event_type") == "click")).alias("diff"))
    w = Window.orderBy("x1")
    return d.withColumn("x2", F.lead("x1").over(w)).withColumn("nxt", F.lead("diff").over(w)).where("diff * nxt < 0").select("x1", "x2")


@query("SELECT * FROM (SELECT user_id, round(avg(value), 9) AS mean, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1 ORDER BY avg(value) DESC, user_id LIMIT 12) WHERE n >= 5")
def top_pages_by_topic(t):
    """The size filter comes after the cut to twelve."""
    per = t.events.where("event_type = 'view'").groupBy("user_id").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    return per.orderBy(F.desc("m"), "user_id").limit(12).where("n >= 5").select("user_id", F.round("m", 9).alias("mean"), "n")


_KNN = """
WITH p AS (SELECT a.vec_id AS q, a.label AS la, b.vec_id AS c, b.label AS lb, round(list_cosine_similarity(list_transform(a.embedding, lambda x: x::DOUBLE), list_transform(b.embedding, lambda x: x::DOUBLE)), 12) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, c) AS r FROM p) WHERE r <= {k})
"""


def _neighbours(t, k):
    n = neighbours.knn(t.embeddings, k)
    own = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("label").alias("la"))
    return n.join(own, "query_id").join(t.embeddings.select("vec_id", F.col("label").alias("lb")), "vec_id")


@query(_KNN.format(k=10) + "SELECT (SELECT round(avg((la = lb)::INT), 9) FROM n) AS purity, (SELECT round(sum(c * c) / (sum(c)::DOUBLE * sum(c)), 9) FROM (SELECT count(*) AS c FROM embeddings GROUP BY label)) AS chance, (SELECT count(*) FROM embeddings) AS n")
def knn_purity(t):
    purity = _neighbours(t, 10).agg(F.round(F.avg((F.col("la") == F.col("lb")).cast("int")), 9).alias("purity"))
    sizes = t.embeddings.groupBy("label").count()
    chance = sizes.agg(F.round(F.sum(F.col("count") * F.col("count")) / (F.sum("count").cast("double") * F.sum("count")), 9).alias("chance"), F.sum("count").alias("n"))
    return purity.crossJoin(F.broadcast(chance))


@query(_KNN.format(k=15) + """, m AS (SELECT q, q % 7 = 0 AS noise, avg(1 - s) AS d, count(DISTINCT lb) AS g FROM n GROUP BY 1, 2)
SELECT round(avg(d) FILTER (noise), 9) AS dist_in, round(avg(d) FILTER (NOT noise), 9) AS dist_out, round(avg(g) FILTER (noise), 9) AS mix_in, round(avg(g) FILTER (NOT noise), 9) AS mix_out,
  round((avg(g) FILTER (noise) - avg(g) FILTER (NOT noise)) / sqrt(var_samp(g) FILTER (noise) / count(*) FILTER (noise) + var_samp(g) FILTER (NOT noise) / count(*) FILTER (NOT noise)), 7) AS t FROM m""")
def knn_mixing_welch(t):
    m = _neighbours(t, 15).groupBy("query_id").agg(F.avg(1 - F.col("similarity")).alias("d"), F.countDistinct("lb").alias("g")).withColumn("noise", F.col("query_id") % 7 == 0)
    side = lambda x, yes: F.when(F.col("noise") if yes else ~F.col("noise"), F.col(x))
    a, b = side("g", True), side("g", False)
    welch = (F.avg(a) - F.avg(b)) / F.sqrt(F.var_samp(a) / F.count(a) + F.var_samp(b) / F.count(b))
    r = lambda c, n: F.round(c, 9).alias(n)
    return m.agg(r(F.avg(side("d", True)), "dist_in"), r(F.avg(side("d", False)), "dist_out"), r(F.avg(a), "mix_in"), r(F.avg(b), "mix_out"), F.round(welch, 7).alias("t"))


_BOXES = "SELECT p_partkey AS id, p_partkey // 200 AS issue, p_brand AS page, (p_partkey % 40)::DOUBLE AS l, (p_partkey % 17)::DOUBLE AS t, (p_partkey % 40 + p_size)::DOUBLE AS r, (p_partkey % 17 + 10)::DOUBLE AS b FROM part"


def _boxes(t):
    p = F.col("p_partkey")
    return t.part.select(p.alias("id"), F.floor(p / 200).alias("issue"), F.col("p_brand").alias("page"), (p % 40).cast("double").alias("l"), (p % 17).cast("double").alias("t"), (p % 40 + F.col("p_size")).cast("double").alias("r"), (p % 17 + 10).cast("double").alias("b"))


@query(f"""
WITH x AS ({_BOXES}), a AS (SELECT * FROM x WHERE id % 2 = 0), b AS (SELECT * FROM x WHERE id % 2 = 1),
j AS (SELECT a.id AS a_id, b.id AS b_id, greatest(0, least(a.r, b.r) - greatest(a.l, b.l)) * greatest(0, least(a.b, b.b) - greatest(a.t, b.t)) AS i, (a.r - a.l) * (a.b - a.t) + (b.r - b.l) * (b.b - b.t) AS u FROM a LEFT JOIN b ON a.page = b.page AND a.issue = b.issue),
v AS (SELECT a_id, b_id, CASE WHEN u - i > 0 THEN i / (u - i) ELSE 0 END AS iou FROM j),
m AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY coalesce(iou, 0) DESC, b_id) AS k FROM v)
SELECT a_id, CASE WHEN iou > 0 THEN b_id END AS b_id, round(coalesce(iou, 0), 9) AS iou FROM m WHERE k = 1""")
def iou_match(t):
    """Within a page, the box that overlaps best; none if no box overlaps."""
    boxes = _boxes(t)
    even = boxes.where("id % 2 = 0")
    met = overlapping(even, boxes.where("id % 2 = 1"), ["issue", "page"], 25.0, 10.0)
    # a box that meets none stands among its pairs with nothing, so the two need no join
    every = even.select(F.col("id").alias("a_id"), F.lit(None).cast("long").alias("b_id"), F.lit(0.0).alias("iou")).union(met)
    return best_box(every).select("a_id", "b_id", F.round("iou", 9).alias("iou"))


#: Boxes whose cells meet in one task, about.
BOXES_PER_TASK = 20_000


def overlapping(a, b, page, wide, high):
    """(a_id, b_id, iou) of boxes that overlap; a pair stands there once for each cell that both touch.

    Only boxes of one page that touch a common cell meet; cells are about as large as
    a box, so a box lies in a few of them. There are as many tasks as the boxes need.
    """
    line = lambda lo, hi, step: F.sequence(F.floor(F.col(lo) / step), F.floor(F.col(hi) / step))
    cells = lambda df, k, v: df.select(F.col("id").alias(k), *page, F.struct("l", "t", "r", "b").alias(v), F.explode(line("l", "r", wide)).alias("cx"), line("t", "b", high).alias("ys")).withColumn("cy", F.explode("ys")).drop("ys")
    side = lambda c: {k: F.col(f"{c}.{k}") for k in "ltrb"}
    at = [*page, "cx", "cy"]
    parts = store.partitions(a.sparkSession, a.count() + b.count(), BOXES_PER_TASK)
    left, right = (cells(*x).repartition(parts, *at) for x in ((a, "a_id", "x"), (b, "b_id", "y")))
    return left.join(right, at).select("a_id", "b_id", M.iou(side("x"), side("y")).alias("iou")).where("iou > 0")


def best_box(met):
    """(a_id, b_id, iou): each box's best overlap, ties to the smaller id."""
    best = met.groupBy("a_id").agg(F.max(F.struct("iou", (-F.col("b_id")).alias("n"))).alias("m"))
    return best.select("a_id", (-F.col("m.n")).alias("b_id"), "m.iou")


@query("SELECT p_partkey AS id, greatest(0, p_partkey % 40 - 4) AS l, greatest(0, p_partkey % 17 - 4) AS t, least(60, p_partkey % 40 + p_size + 4) AS r, least(24, p_partkey % 17 + 10 + 4) AS b FROM part WHERE p_type <> 'SMALL'")
def clamped_boxes(t):
    """Title blocks (here one type) go; the others get a margin within their image."""
    p = F.col("p_partkey")
    return t.part.where("p_type <> 'SMALL'").select(p.alias("id"), *(c.alias(n) for n, c in zip("ltrb", M.padded_box(p % 40, p % 17, F.col("p_size"), F.lit(10), F.lit(60).cast("long"), F.lit(24).cast("long")))))


@query("WITH u AS (SELECT doc_id AS key, source AS value, 0 AS p FROM documents UNION ALL SELECT doc_id, 'q' || quality, 1 FROM labels) SELECT key, arg_max(value, p) AS value FROM u GROUP BY 1")
def merge_last_wins(t):
    both = t.documents.select(F.col("doc_id").alias("key"), F.col("source").alias("value"), F.lit(0).alias("p")).union(t.labels.select("doc_id", F.concat(F.lit("q"), "quality"), F.lit(1)))
    return both.groupBy("key").agg(F.max_by("value", "p").alias("value"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def latest_answer(t):
    return t.events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))


@query("WITH d AS (SELECT source, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS k FROM documents GROUP BY 1) SELECT source, CASE WHEN k > 2 THEN 'done' ELSE 'todo' END AS status, n FROM d")
def resume_anti_join(t):
    """Sources with results are skipped but still counted."""
    done = t.documents.select("doc_id", "source").join(t.labels.where("toxic = 1").select("doc_id"), "doc_id", "left_semi").groupBy("source").count().where("count > 2").select("source", F.lit("done").alias("done"))
    n = t.documents.groupBy("source").agg(F.count("*").alias("n"))
    return n.join(done, "source", "left").select("source", F.coalesce("done", F.lit("todo")).alias("status"), "n")


@query("""
WITH r AS (SELECT p_brand AS run, count(*) AS docs, max(p_size) AS big, min(p_size) AS small FROM part GROUP BY 1), a AS (SELECT p_brand AS run, round(avg(p_retailprice), 4) AS v FROM part WHERE p_type = 'SMALL' GROUP BY 1 HAVING count(*) > 13),
b AS (SELECT p_brand AS run, round(max(p_retailprice), 4) AS v FROM part WHERE p_type = 'ECONOMY' GROUP BY 1 HAVING count(*) > 14)
SELECT row_number() OVER (ORDER BY coalesce(a.v, b.v, 0) DESC, docs, run) AS pos, run, docs, coalesce(a.v, b.v) AS npmi, round(big / nullif(small, 0)::DOUBLE, 1) AS ratio FROM r LEFT JOIN a USING (run) LEFT JOIN b USING (run) WHERE docs >= 60""")
def run_recap(t):
    """Runs with optional measurements, the later kind overriding the earlier; missing ones sort as 0."""
    r = t.part.groupBy(F.col("p_brand").alias("run")).agg(F.count("*").alias("docs"), F.max("p_size").alias("big"), F.min("p_size").alias("small")).where("docs >= 60")
    pick = lambda kind, agg, least, name: t.part.where(F.col("p_type") == kind).groupBy(F.col("p_brand").alias("run")).agg(F.round(agg("p_retailprice"), 4).alias(name), F.count("*").alias("c")).where(F.col("c") > least).drop("c")
    rows = r.join(pick("SMALL", F.avg, 13, "a"), "run", "left").join(pick("ECONOMY", F.max, 14, "b"), "run", "left").withColumn("npmi", F.coalesce("a", "b"))
    pos = F.row_number().over(Window.orderBy(F.coalesce("npmi", F.lit(0.0)).desc(), "docs", "run"))
    return rows.select(pos.cast("long").alias("pos"), "run", "docs", "npmi", F.round(F.col("big") / F.nullif("small", F.lit(0)), 1).alias("ratio"))


@query("""
WITH g AS (SELECT l.lang, s.source FROM (SELECT DISTINCT lang FROM documents) l, (SELECT DISTINCT source FROM documents) s), d AS (SELECT lang, source, count(*) AS n, avg(n_chars) AS mean FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1, 2)
SELECT lang, source, coalesce(n, 0) AS n, round(mean, 6) AS mean FROM g FULL JOIN d USING (lang, source)
UNION ALL SELECT lang, 'all', sum(n)::BIGINT, round(avg(mean), 6) FROM d GROUP BY 1""")
def full_outer_grid(t):
    """Absent cells stay, as zero and blank; the mean of a language is the mean of its sources' means."""
    measured = t.documents.join(t.labels.where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    d = measured.groupBy("lang", "source").agg(F.count("*").alias("n"), F.avg("n_chars").alias("m"))
    grid = t.documents.select("lang").distinct().crossJoin(t.documents.select("source").distinct())
    cells = grid.join(d, ["lang", "source"], "full").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.round("m", 6).alias("mean"))
    return cells.union(d.groupBy("lang").agg(F.sum("n").alias("n"), F.round(F.avg("m"), 6).alias("mean")).select("lang", F.lit("all"), "n", "mean"))


@query("SELECT 'missing' AS side, count(*) AS n FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'common', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'agree', count(*) FROM documents JOIN labels USING (doc_id) WHERE doc_id % 2 = quality")
def missing_keys(t):
    both = t.documents.select("doc_id").distinct().join(t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.count("*").alias("c")), "doc_id", "left")
    n = both.agg(F.count_if(F.col("c").isNull()).alias("missing"), F.count("c").alias("common"), F.coalesce(F.sum(F.when(F.col("doc_id") % 2 == F.col("quality"), F.col("c"))), F.lit(0)).alias("agree"))
    return n.select(F.stack(F.lit(3), F.lit("missing"), "missing", F.lit("common"), "common", F.lit("agree"), "agree").alias("side", "n"))


@query(f"SELECT topic, arg_min(bucket, (-n, bucket))::INT AS peak_bucket, max(n) AS peak, row_number() OVER (ORDER BY arg_min(bucket, (-n, bucket)), -max(n), topic) AS pos FROM ({_BUCKET}) GROUP BY topic")
def peak_order(t):
    top = _buckets(t).groupBy("topic").agg(F.min(F.struct((-F.col("n")).alias("m"), "bucket")).alias("p"))
    flat = top.select("topic", F.col("p.bucket").alias("peak_bucket"), (-F.col("p.m")).alias("peak"))
    return flat.withColumn("pos", F.row_number().over(Window.orderBy("peak_bucket", F.desc("peak"), "topic")).cast("long"))


@query("SELECT url, page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, (len(html) - len(replace(html, '<a ', ''))) // 3 AS n_links FROM pages")
def page_titles(t):
    """Markup that isn't well formed is read by pattern, as the regex scans do."""
    return t.pages.select("url", "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<a ")).cast("long").alias("n_links"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_window_counts(t):
    return windows.run_once(t.spark, f"{t.dir}/events.parquet", "1 day")


@query()
def kmeans_groups(t):
    return learning.kmeans(t.embeddings, k=10)


@query()
def lda_topics(t):
    return learning.lda(t.texts("doc_id", "text").select("doc_id", X.normalised("text", min_len=3).alias("tokens")), k=8)


@query()
def pca_projection(t):
    return learning.pca(t.embeddings, 5)


@query()
def density_groups(t):
    return learning.density(t.embeddings, radius=1.12, least=4)


_CELLS = JOINED + """, ce AS (SELECT first AS a, enc AS b, count(*) AS n FROM j GROUP BY 1, 2),
lf AS (SELECT a, row_number() OVER (ORDER BY sum(n) DESC, a) AS p FROM ce GROUP BY 1), rg AS (SELECT b, row_number() OVER (ORDER BY sum(n) DESC, b) AS q FROM ce GROUP BY 1)
"""


def _cells(t):
    return sorted((r["row"], r["col"], r["n"]) for r in confusion_matrix(t).collect())


@query("WITH RECURSIVE" + _CELLS.strip().removeprefix("WITH") + """, x AS (SELECT rg.q, rg.b, lf.a, lf.p, coalesce(ce.n, 0) AS n FROM rg CROSS JOIN lf LEFT JOIN ce ON ce.a = lf.a AND ce.b = rg.b),
m AS (SELECT 0::BIGINT AS q, NULL::INT AS b, NULL::INT AS a, []::INT[] AS used
  UNION ALL SELECT * FROM (SELECT x.q, x.b, x.a, list_append(m.used, x.a) AS used FROM m JOIN x ON x.q = m.q + 1 WHERE NOT list_contains(m.used, x.a)
    ORDER BY x.n DESC, x.p LIMIT 1))
SELECT b, a FROM m WHERE q > 0""")
def greedy_match(t):
    """Each group of the second partition and the one of the first that it takes."""
    return t.small(list(trials.match_groups(_cells(t)).items()), "b int, a int")


@query()
def diagonal_order(t):
    """Rows and columns of the confusion matrix in the order that puts matches on the diagonal."""
    rows, columns = trials.diagonal_order(_cells(t))
    return t.small([("row", i, x) for i, x in enumerate(rows)] + [("col", i, x) for i, x in enumerate(columns)], "side string, pos int, name int")


@query("SELECT source, doc_id, array_to_string(list_filter(['A', 'B', 'C'], lambda l: (l = 'A' AND list_contains({w}, 'the')) OR (l = 'B' AND list_contains({w}, 'de')) OR (l = 'C' AND list_contains({w}, 'und'))), ',') AS themes FROM documents")
def stub_classify(t):
    """The whole path of a batched model call, with a client that looks for words."""
    articles = t.documents.select("source", "doc_id", "text", X.n_tokens("text").alias("tok"))
    got = labelling.classify(articles, labelling.keyword_client({"the": "A", "de": "B", "und": "C"}), ["A", "B", "C"], group="source", key="doc_id", fixed=9012)
    # written here, so that its batches of texts are bounded by bytes
    return store.written(got.select("source", "doc_id", F.array_join("themes", ",").alias("themes")), "classified")

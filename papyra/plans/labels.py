"""Queries over label sets, hierarchies and evaluation trials."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyra.functions import measures as M
from papyra.functions import text as X
from papyra.operators import batching, requests, taxonomy, trials

from .registry import query

EDGES = """
WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS code, NULL::VARCHAR AS parent FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION ALL SELECT * FROM (VALUES ('n98', 'r0'), ('n99', 'r1')) v
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  {more}),
p AS (SELECT code, 1 AS depth, [code] AS path FROM e WHERE parent IS NULL
  UNION ALL SELECT e.code, p.depth + 1, list_append(p.path, e.code) FROM e JOIN p ON e.parent = p.path[-1] WHERE NOT list_contains(p.path, e.code))
"""
BASE = EDGES.replace("{more}", "")
SETS = """
WITH s AS (SELECT l_orderkey AS o,
  coalesce(list_sort(list(DISTINCT l_suppkey) FILTER (l_linenumber <= 3)), []) AS a, coalesce(list_sort(list(DISTINCT l_suppkey) FILTER (l_returnflag <> 'N')), []) AS b FROM lineitem GROUP BY 1)
"""
JACCARD = "CASE WHEN len(list_distinct(a || b)) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(a || b))::DOUBLE END"
ROOTS = """
, l AS (SELECT l_orderkey AS o, (l_linenumber, l_suppkey) AS pos, n_regionkey AS root FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
c AS (SELECT o_orderkey AS o, n_regionkey AS enc, o_totalprice AS score FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
j AS (SELECT c.o, enc, score, list_sort(list(DISTINCT root)) AS roots, arg_min(root, pos) AS first, count(DISTINCT root) AS k FROM c JOIN l USING (o) GROUP BY 1, 2, 3)
"""
JOINED = "WITH z AS (SELECT 1)" + ROOTS


def edges(t, more: bool = False):
    """Regions, nations (two without anything below), and all suppliers and customers."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    out = t.region.select(key("r", "r_regionkey").alias("code"), F.lit(None).cast("string").alias("parent"))
    out = out.union(t.nation.select(key("n", "n_nationkey"), key("r", "n_regionkey")))
    out = out.union(t.small([("n98", "r0"), ("n99", "r1")], "code string, parent string"))
    out = out.union(t.supplier.select(key("s", "s_suppkey"), key("n", "s_nationkey"))).union(t.customer.select(key("c", "c_custkey"), key("n", "c_nationkey")))
    if more:
        out = out.union(t.small([("x1", "gone"), ("y1", "y2"), ("y2", "y1")], "code string, parent string"))
    return out


def sets(t):
    """Each order's two label sets, as sorted arrays."""
    pick = lambda c: F.sort_array(F.collect_set(F.when(c, F.col("l_suppkey"))))
    return t.lineitem.groupBy(F.col("l_orderkey").alias("o")).agg(pick(F.col("l_linenumber") <= 3).alias("a"), pick(F.col("l_returnflag") != "N").alias("b"))


def supplier_roots(t):
    nation = t.nation.select("n_nationkey", F.col("n_regionkey").alias("root"))
    return t.supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "root")


def compared(t):
    """Orders with their customer's root (one label) and their suppliers' roots (several)."""
    lines = t.lineitem.join(supplier_roots(t), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_orderkey").alias("o"))
    lines = lines.agg(F.sort_array(F.collect_set("root")).alias("roots"), F.min_by("root", F.struct("l_linenumber", "l_suppkey")).alias("first"))
    nation = t.nation.select("n_nationkey", F.col("n_regionkey").alias("enc"))
    who = t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "enc")
    orders = t.orders.join(who, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("o"), "enc", F.col("o_totalprice").alias("score"))
    return orders.join(lines, "o").withColumn("k", F.size("roots").cast("long"))


@query(BASE + "SELECT code, depth FROM p")
def taxonomy_depth(t):
    return taxonomy.depths(edges(t)).select("code", "depth")


@query(BASE + "SELECT m AS max_level, code, coalesce(path[1], '') AS l1, coalesce(path[2], '') AS l2, coalesce(path[3], '') AS l3 FROM p, (VALUES (2), (3)) v(m) WHERE depth = m OR (depth < m AND code NOT IN (SELECT parent FROM e WHERE parent IS NOT NULL))")
def taxonomy_leaves(t):
    e = edges(t)
    known = taxonomy.depths(e)
    one = lambda m: taxonomy.leaves(e, m, known).select(F.lit(m).alias("max_level"), "code", "l1", "l2", "l3")
    return one(2).union(one(3))


@query(BASE + "SELECT path[1] AS l1, count(*) AS n, min(code) AS first FROM p WHERE depth = 3 OR (depth < 3 AND code NOT IN (SELECT parent FROM e WHERE parent IS NOT NULL)) GROUP BY 1")
def label_families(t):
    """The candidate labels of each first-level family."""
    f = taxonomy.families(taxonomy.leaves(edges(t), 3))
    return f.select("l1", F.size("codes").cast("long").alias("n"), F.get("codes", F.lit(0)).alias("first"))


@query(EDGES.replace("{more}", "UNION ALL SELECT * FROM (VALUES ('x1', 'gone'), ('y1', 'y2'), ('y2', 'y1')) v") + "SELECT e.code, p.path[1] AS root FROM e LEFT JOIN p USING (code)")
def taxonomy_rollup(t):
    return taxonomy.rollup(edges(t, more=True))


@query(BASE + "SELECT p.code AS l2, (SELECT count(*) FROM e WHERE e.parent = p.code) AS n_children, (SELECT count(*) FROM e WHERE e.parent = p.code) = 0 AS terminal FROM p WHERE depth = 2")
def cascade_stage_index(t):
    return taxonomy.stage_index(edges(t))


_ROUTE = BASE + f""", s AS (SELECT code, (SELECT count(*) FROM e WHERE e.parent = p.code) AS k FROM p WHERE depth = 2),
r AS (SELECT CASE WHEN c_acctbal < 0 THEN 'unassigned' WHEN s.k > 0 THEN 'branch' ELSE 'terminal' END AS route FROM orders JOIN customer ON o_custkey = c_custkey JOIN s ON s.code = CASE WHEN c_nationkey % 5 = 0 THEN 'n98' ELSE 'n' || c_nationkey END)
SELECT route, count(*) AS n FROM r GROUP BY 1"""


@query(_ROUTE)
def cascade_routing(t):
    """After stage 1: terminal labels are done, branches go on; here customers in debt have no label."""
    stage = taxonomy.stage_index(edges(t))
    l2 = F.when(F.col("c_nationkey") % 5 == 0, "n98").otherwise(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")))
    who = t.customer.select("c_custkey", l2.alias("l2"), "c_acctbal")
    rows = t.orders.select("o_custkey").join(who, F.col("o_custkey") == F.col("c_custkey")).join(stage, "l2")
    return rows.groupBy(F.when(F.col("c_acctbal") < 0, "unassigned").when(F.col("terminal"), "terminal").otherwise("branch").alias("route")).agg(F.count("*").alias("n"))


@query("""
WITH o AS (SELECT c_nationkey AS branch, count(*) AS observed FROM customer GROUP BY 1), f AS (SELECT (SELECT count(*) FROM orders) / (SELECT count(*) FROM customer)::DOUBLE AS scale)
SELECT branch, observed, greatest(1, round_even(observed * scale, 0))::BIGINT AS scaled, ceil(greatest(1, round_even(observed * scale, 0)) / least(25, greatest(1, floor((40000 - 2000) / 536.8))))::BIGINT AS lots FROM o, f""")
def cascade_extrapolation(t):
    """The branches' observed numbers, scaled to the whole corpus, never below 1."""
    seen = t.customer.groupBy(F.col("c_nationkey").alias("branch")).agg(F.count("*").alias("observed"))
    scale = t.orders.agg(F.count("*").alias("x")).crossJoin(F.broadcast(t.customer.agg(F.count("*").alias("y")))).select((F.col("x") / F.col("y")).alias("scale"))
    scaled = F.greatest(F.lit(1), F.bround(F.col("observed") * F.col("scale"), 0)).cast("long")
    return seen.crossJoin(F.broadcast(scale)).select("branch", "observed", scaled.alias("scaled"), batching.lots_needed(scaled, F.lit(521.8), 2000).alias("lots"))


@query("SELECT n_regionkey AS root, count(DISTINCT o_custkey) AS used, count(DISTINCT c_custkey) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def taxonomy_coverage(t):
    used = t.orders.select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("used", F.lit(1))
    who = t.customer.join(used, "c_custkey", "left").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return who.groupBy(F.col("n_regionkey").alias("root")).agg(F.count("used").alias("used"), F.count("*").alias("total"))


@query("SELECT n_regionkey AS root, count(DISTINCT o_custkey) AS n_labels FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def labels_absorbed(t):
    used = t.orders.select(F.col("o_custkey").alias("c_custkey")).distinct()
    return used.join(t.customer, "c_custkey").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("root")).agg(F.count("*").alias("n_labels"))


@query("WITH z AS (SELECT 1), l AS (SELECT l_orderkey AS o, (l_linenumber, l_suppkey) AS pos, n_regionkey AS root FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey), f AS (SELECT o, arg_min(root, pos) AS first FROM l GROUP BY 1) SELECT root, (SELECT count(*) FROM f WHERE first = root) AS n_first, count(DISTINCT o) AS n_any FROM l GROUP BY 1")
def branch_first_vs_any(t):
    per = t.lineitem.join(supplier_roots(t), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_orderkey")).agg(F.min_by("root", F.struct("l_linenumber", "l_suppkey")).alias("first"), F.collect_set("root").alias("roots"))
    return per.select("first", F.explode("roots").alias("root")).groupBy("root").agg(F.count_if(F.col("first") == F.col("root")).alias("n_first"), F.count("*").alias("n_any"))


@query(SETS + f"SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (a = b) AS identical, count(*) FILTER (len(list_intersect(a, b)) = 0) AS disjoint, round(avg({JACCARD}), 9) AS mean_jaccard, round(avg(len(a)), 9) AS labels_a, round(avg(len(b)), 9) AS labels_b FROM s JOIN orders ON o = o_orderkey GROUP BY 1")
def regime_jaccard(t):
    """Here two empty sets are both identical and disjoint."""
    a, b = F.col("a"), F.col("b")
    rows = sets(t).join(t.orders, F.col("o") == F.col("o_orderkey"))
    mean = lambda c: F.round(F.avg(c), 9)
    return rows.groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count("*").alias("n"), F.count_if(M.same_set(a, b)).alias("identical"), F.count_if(~F.arrays_overlap(a, b)).alias("disjoint"),
        mean(M.jaccard(a, b)).alias("mean_jaccard"), mean(F.size("a")).alias("labels_a"), mean(F.size("b")).alias("labels_b"),
    )


@query(SETS + ", k AS (SELECT CASE WHEN a = b THEN 'identical' WHEN len(list_intersect(a, b)) > 0 THEN 'partial' ELSE 'disjoint' END AS class FROM s) SELECT class, count(*) AS n, (100 * count(*) // (SELECT count(*) FROM k))::BIGINT AS pct_floor FROM k GROUP BY 1")
def regime_overlap_classes(t):
    n = sets(t).groupBy(M.overlap_class(F.col("a"), F.col("b")).alias("class")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select("class", "n", M.percent_floor(F.col("n"), F.col("all")).alias("pct_floor"))


@query(SETS + "SELECT label, count(*) AS n FROM (SELECT unnest(list_filter(a, lambda x: NOT list_contains(b, x))) AS label FROM s) GROUP BY 1")
def new_labels(t):
    return sets(t).select(F.explode(F.array_except("a", "b")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("""
WITH x AS (SELECT l_orderkey AS o, l_linenumber AS num, (l_linenumber, l_suppkey) AS pos, s_nationkey AS fam, l_returnflag FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
g AS (SELECT o, arg_min(fam, pos) FILTER (num <= 3) AS first, list(DISTINCT fam) FILTER (l_returnflag <> 'N') AS fams FROM x GROUP BY 1)
SELECT count(*) FILTER (list_contains(fams, first)) AS hits, count(*) AS total FROM g WHERE first IS NOT NULL AND len(fams) > 0""")
def family_hit_rate(t):
    x = t.lineitem.join(t.supplier.select("s_suppkey", F.col("s_nationkey").alias("fam")), F.col("l_suppkey") == F.col("s_suppkey"))
    g = x.groupBy("l_orderkey").agg(F.min_by(F.when(F.col("l_linenumber") <= 3, F.col("fam")), F.when(F.col("l_linenumber") <= 3, F.struct("l_linenumber", "l_suppkey"))).alias("first"), F.collect_set(F.when(F.col("l_returnflag") != "N", F.col("fam"))).alias("fams"))
    g = g.where(F.col("first").isNotNull() & (F.size("fams") > 0))
    return g.agg(F.count_if(F.array_contains("fams", F.col("first"))).alias("hits"), F.count("*").alias("total"))


@query(JOINED + "SELECT count(*) AS n, count(*) FILTER (list_contains(roots, enc)) AS broad, count(*) FILTER (first = enc) AS strict FROM j")
def agreement_broad_strict(t):
    return compared(t).agg(F.count("*").alias("n"), F.count_if(F.array_contains("roots", F.col("enc"))).alias("broad"), F.count_if(F.col("first") == F.col("enc")).alias("strict"))


@query(JOINED + "SELECT k AS n_labels, count(*) FILTER (list_contains(roots, enc)) AS hits, count(*) AS n FROM j GROUP BY 1")
def agreement_by_size(t):
    return compared(t).groupBy(F.col("k").alias("n_labels")).agg(F.count_if(F.array_contains("roots", F.col("enc"))).alias("hits"), F.count("*").alias("n"))


@query(JOINED + ", q AS (SELECT *, score / (SELECT max(score) FROM j) AS p FROM j) SELECT CASE WHEN p < .5 THEN '[0,.5)' WHEN p < .9 THEN '[.5,.9)' WHEN p < .99 THEN '[.9,.99)' ELSE '[.99,1.01)' END AS bucket, count(*) FILTER (list_contains(roots, enc)) AS hits, count(*) AS n FROM q GROUP BY 1")
def agreement_by_score(t):
    rows = compared(t)
    p = F.col("score") / F.col("top")
    bucket = F.when(p < 0.5, "[0,.5)").when(p < 0.9, "[.5,.9)").when(p < 0.99, "[.9,.99)").otherwise("[.99,1.01)")
    return rows.crossJoin(F.broadcast(rows.agg(F.max("score").alias("top")))).groupBy(bucket.alias("bucket")).agg(F.count_if(F.array_contains("roots", F.col("enc"))).alias("hits"), F.count("*").alias("n"))


@query(JOINED + "SELECT enc, first AS llm, count(*) AS n FROM j WHERE NOT list_contains(roots, enc) GROUP BY 1, 2 ORDER BY n DESC, enc, llm LIMIT 15")
def top_disagreements(t):
    rows = compared(t).where(~F.array_contains("roots", F.col("enc")))
    return rows.groupBy("enc", F.col("first").alias("llm")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "enc", "llm").limit(15)


@query(JOINED + ", e AS (SELECT enc, count(*) AS c FROM j GROUP BY 1), r AS (SELECT unnest(roots) AS root FROM j), s AS (SELECT root, count(*) AS m FROM r GROUP BY 1) SELECT (SELECT count(*) FROM j) AS n, round(sum(c * m) / ((SELECT count(*) FROM j)::DOUBLE * (SELECT count(*) FROM j)), 9) AS expected FROM e JOIN s ON enc = root")
def permutation_control(t):
    """The expectation of agreement under shuffling, in closed form."""
    rows = compared(t)
    n = rows.agg(F.count("*").alias("n"))
    both = rows.groupBy("enc").agg(F.count("*").alias("c")).join(rows.select(F.explode("roots").alias("enc")).groupBy("enc").agg(F.count("*").alias("m")), "enc")
    return both.agg(F.sum(F.col("c") * F.col("m")).alias("s")).crossJoin(F.broadcast(n)).select("n", F.round(F.col("s") / (F.col("n").cast("double") * F.col("n")), 9).alias("expected"))


@query(JOINED + 'SELECT first AS "row", enc AS col, count(*) AS n, first = enc AS diagonal FROM j GROUP BY 1, 2')
def confusion_matrix(t):
    return compared(t).groupBy(F.col("first").alias("row"), F.col("enc").alias("col")).agg(F.count("*").alias("n")).withColumn("diagonal", F.col("row") == F.col("col"))


@query("""
WITH c AS (SELECT c_mktsegment AS a, o_orderpriority AS b, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), t AS (SELECT sum(n)::DOUBLE AS n FROM c),
x AS (SELECT a, sum(n) AS n FROM c GROUP BY 1), y AS (SELECT b, sum(n) AS n FROM c GROUP BY 1),
h AS (SELECT (SELECT -sum(x.n / t.n * ln(x.n / t.n)) FROM x, t) AS ha, (SELECT -sum(y.n / t.n * ln(y.n / t.n)) FROM y, t) AS hb,
  (SELECT sum(c.n / t.n * ln(c.n * t.n / (x.n * y.n)::DOUBLE)) FROM c JOIN x USING (a) JOIN y USING (b), t) AS mi)
SELECT (SELECT n FROM t)::BIGINT AS n, round(ha, 9) AS h_a, round(hb, 9) AS h_b, round(mi, 9) AS mi, round(2 * mi / (ha + hb), 9) AS nmi FROM h""")
def contingency_nmi(t):
    c = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("a"), F.col("o_orderpriority").alias("b")).agg(F.count("*").alias("n"))
    return trials.nmi(c, "a", "b")


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || doc_id), doc_id) AS r FROM documents) WHERE r <= 20")
def stratified_quota(t):
    return trials.quota(t.documents.select("lang", "doc_id"), "lang", "doc_id", 20, "7")


_BANDS = "CASE WHEN n < 2 THEN 'hapax' WHEN n < 10 THEN 'rare' WHEN n < 100 THEN 'medium' ELSE 'frequent' END"
_DECOYS = f"""
WITH u AS (SELECT DISTINCT l_orderkey AS article, l_suppkey AS label FROM lineitem), f AS (SELECT label, count(*) AS n FROM u GROUP BY 1), b AS (SELECT label, {_BANDS} AS band FROM f),
own AS (SELECT * FROM u JOIN b USING (label)), a AS (SELECT article, arg_min(band, label) AS band FROM own GROUP BY 1), m AS (SELECT article, band, count(*) AS mine FROM own GROUP BY 1, 2),
p AS (SELECT band, label, row_number() OVER (PARTITION BY band ORDER BY md5('7|' || label), label) - 1 AS place, count(*) OVER (PARTITION BY band) AS size FROM b),
s AS (SELECT article, band, size, ('0x' || substr(md5('7|' || article), 1, 15))::BIGINT % size AS start, unnest(range(0, least(mine, size - 1) + 1)) AS step FROM a JOIN m USING (article, band) JOIN (SELECT DISTINCT band, size FROM p) USING (band)),
c AS (SELECT * FROM (SELECT s.article, step, p.label FROM s JOIN p ON p.band = s.band AND p.place = (start + step) % s.size) x WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.article = x.article AND u.label = x.label)),
d AS (SELECT a.article, a.band, x.decoy FROM a LEFT JOIN (SELECT article, arg_min(label, step) AS decoy FROM c GROUP BY 1) x USING (article))
"""


def _uses(t):
    """Every article's labels, and the labels' bands by counts over all articles."""
    u = t.lineitem.select(F.col("l_orderkey").alias("article"), F.col("l_suppkey").alias("label")).distinct()
    return u, u.groupBy("label").agg(F.count("*").alias("n")).select("label", X.band("n").alias("band"))


@query(_DECOYS + "SELECT article, decoy FROM d")
def decoy_candidates(t):
    """For each article, a label of its band that it doesn't have."""
    return trials.decoys(*_uses(t), "7")


@query(_DECOYS + """,
q AS (SELECT 60 // count(DISTINCT band) AS quota FROM a), k AS (SELECT article, band FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY md5('7|' || article), article) AS r FROM a) WHERE r <= (SELECT quota FROM q)),
o AS (SELECT k.article, arg_min(u.label, md5('7t|' || k.article || '|' || u.label)) AS own FROM k JOIN u ON u.article = k.article GROUP BY 1),
z AS (SELECT k.article, k.band, o.own, d.decoy, ('0x' || substr(md5('7c|' || k.article), 1, 1))::INT % 2 = 0 AS is_true FROM k JOIN o ON o.article = k.article JOIN d ON d.article = k.article),
y AS (SELECT article, band, is_true, CASE WHEN is_true THEN own ELSE decoy END AS label FROM z)
SELECT printf('B%03d', row_number() OVER (ORDER BY md5('7o|' || article), article)) AS item, article, label, is_true, band FROM y WHERE label IS NOT NULL""")
def trial_items(t):
    """A blind trial: bands share sixty items, a coin shows a true label or a decoy."""
    return trials.kit(*_uses(t), 60, "7")


@query("SELECT DISTINCT l_orderkey AS article, l_suppkey AS label FROM lineitem WHERE (l_orderkey, l_suppkey) NOT IN (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')")
def anti_already_judged(t):
    """Labels of articles, without the pairs that are judged already (here: those of returned lines)."""
    pair = [F.col("l_orderkey").alias("article"), F.col("l_suppkey").alias("label")]
    judged = t.lineitem.where("l_returnflag = 'R'").select(*pair)
    return t.lineitem.select(*pair).distinct().join(judged, ["article", "label"], "left_anti")


_W = "coalesce(yes / nullif(n::DOUBLE, 0), 0)"


@query(f"""
WITH g AS (SELECT lang, CASE WHEN toxic = 1 THEN 'decoy' ELSE 'true' END AS truth, count(*) AS n, sum(quality)::BIGINT AS yes FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2),
x AS (SELECT *, {_W} AS p FROM g)
SELECT lang, truth, n, yes, round(greatest(0, (p + 1.96*1.96/(2*n)) / (1 + 1.96*1.96/n) - 1.96 * sqrt(p*(1-p)/n + 1.96*1.96/(4.0*n*n)) / (1 + 1.96*1.96/n)), 9) AS lo,
  round(least(1, (p + 1.96*1.96/(2*n)) / (1 + 1.96*1.96/n) + 1.96 * sqrt(p*(1-p)/n + 1.96*1.96/(4.0*n*n)) / (1 + 1.96*1.96/n)), 9) AS hi FROM x""")
def wilson_rates(t):
    g = t.documents.select("doc_id", "lang").join(t.labels, "doc_id").groupBy("lang", F.when(F.col("toxic") == 1, "decoy").otherwise("true").alias("truth")).agg(F.count("*").alias("n"), F.sum("quality").alias("yes"))
    lo, hi = M.wilson(F.col("yes"), F.col("n"))
    return g.select("lang", "truth", "n", "yes", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


@query("SELECT round(a - b, 9) AS gap, a - b < 0.20 AS suspect FROM (SELECT avg(quality) FILTER (toxic = 0) AS a, avg(quality) FILTER (toxic = 1) AS b FROM labels)")
def acceptance_gap(t):
    gap = F.avg(F.when(F.col("toxic") == 0, F.col("quality"))) - F.avg(F.when(F.col("toxic") == 1, F.col("quality")))
    return t.labels.agg(gap.alias("g")).select(F.round("g", 9).alias("gap"), (F.col("g") < 0.20).alias("suspect"))


@query("""
WITH u AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS label FROM lineitem WHERE l_linenumber = 1), x AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS label FROM lineitem WHERE l_linenumber = 2),
y AS (SELECT DISTINCT l_orderkey AS o, l_suppkey % 10 AS label FROM lineitem WHERE l_linenumber = 3)
SELECT ((x.o IS NOT NULL)::INT + (y.o IS NOT NULL)::INT)::INT AS n_confirm, sum((o_orderstatus = 'F')::INT)::BIGINT AS yes, count(*) AS n
FROM u JOIN orders ON u.o = o_orderkey LEFT JOIN x ON u.o = x.o AND u.label = x.label LEFT JOIN y ON u.o = y.o AND u.label % 10 = y.label GROUP BY 1""")
def consensus_acceptance(t):
    """Acceptance by the number of independent reruns that confirm a label."""
    pick = lambda i, c: t.lineitem.where(F.col("l_linenumber") == i).select(F.col("l_orderkey").alias("o"), c.alias("label")).distinct()
    u = pick(1, F.col("l_suppkey")).withColumn("short", F.col("label") % 10)
    x, y = pick(2, F.col("l_suppkey")).withColumn("x", F.lit(1)), pick(3, F.col("l_suppkey") % 10).select("o", F.col("label").alias("short"), F.lit(1).alias("y"))
    rows = u.join(t.orders.select(F.col("o_orderkey").alias("o"), "o_orderstatus"), "o").join(x, ["o", "label"], "left").join(y, ["o", "short"], "left")
    n = F.coalesce("x", F.lit(0)) + F.coalesce("y", F.lit(0))
    return rows.groupBy(n.alias("n_confirm")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("yes"), F.count("*").alias("n"))


@query("""
WITH g AS (SELECT sum((lang = 'en')::INT)::DOUBLE AS n1, sum((lang = 'fr')::INT)::DOUBLE AS n2, avg(quality) FILTER (lang = 'en') AS p1, avg(quality) FILTER (lang = 'fr') AS p2 FROM documents JOIN labels USING (doc_id) WHERE lang IN ('en', 'fr'))
SELECT round((p1 - p2) / sqrt((p1*n1 + p2*n2) / (n1+n2) * (1 - (p1*n1 + p2*n2) / (n1+n2)) * (1/n1 + 1/n2)), 9) AS z FROM g""")
def two_proportion_z(t):
    rows = t.documents.select("doc_id", "lang").where(F.col("lang").isin("en", "fr")).join(t.labels, "doc_id")
    return trials.two_proportions(rows, F.col("lang") == "en", F.col("quality"))


@query("SELECT count(*) AS n, sum((quality = 1 - toxic)::INT)::BIGINT AS agree, (SELECT round(avg(value), 9) FROM events WHERE event_type = 'view') AS mean FROM labels")
def annotator_agreement(t):
    both = t.labels.agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1 - F.col("toxic")).alias("agree"))
    return both.crossJoin(F.broadcast(t.events.where("event_type = 'view'").agg(F.round(F.avg("value"), 9).alias("mean"))))


@query("SELECT o, list_filter(codes, lambda x: x % 10 < 7)[1:5] AS codes FROM (SELECT l_orderkey AS o, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS codes FROM lineitem GROUP BY 1) WHERE len(list_filter(codes, lambda x: x % 10 < 7)) >= 1".join(['SELECT o AS "order", array_to_string(codes, \',\') AS codes FROM (', ")"]))
def valid_codes(t):
    """Known codes only, the first five in their order; articles without any go."""
    known = t.supplier.where("s_suppkey % 10 < 7").select(F.col("s_suppkey").alias("l_suppkey"))
    per = t.lineitem.join(known, "l_suppkey", "left_semi").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("c"))
    return per.select(F.col("l_orderkey").alias("order"), F.array_join(F.slice(F.transform("c", lambda x: x["l_suppkey"].cast("string")), 1, 5), ",").alias("codes"))


@query("""
WITH x AS (SELECT l_orderkey AS o, list(DISTINCT s_nationkey) AS k FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
y AS (SELECT CASE WHEN len(k) > 5 THEN 'number of themes' WHEN list_max(k) >= 20 THEN 'unknown theme' ELSE 'none' END AS problem, least(5, len(list_filter(k, lambda n: n < 20))) AS kept FROM x)
SELECT problem, count(*) AS n, sum(kept)::BIGINT AS kept FROM y GROUP BY 1""")
def strict_answers(t):
    """Raw replies (here: each order's nations as JSON) against a strict schema, and what of them is usable."""
    known = t.supplier.select("s_suppkey", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("code"))
    themes = t.lineitem.join(known, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("l_orderkey").agg(F.collect_set("code").alias("themes"))
    got = requests.answers(themes.select(F.to_json(F.struct("themes")).alias("reply")), "reply", [f"n{i}" for i in range(20)])
    kept = F.sum(F.coalesce(F.size(F.get("entries", F.lit(0))["themes"]), F.lit(0)))
    return got.groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("n"), kept.alias("kept"))


@query("SELECT d.doc_id, CASE WHEN regexp_matches(d.title, '^[A-Z]+\\.[0-9]+$') THEN '' ELSE d.title END || coalesce(quality::VARCHAR, '(unavailable)') AS shown FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'DIV.' || doc_id ELSE source END AS title FROM documents) d LEFT JOIN labels USING (doc_id)")
def left_placeholder(t):
    title = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("DIV."), "doc_id")).otherwise(F.col("source"))
    return t.documents.select("doc_id", title.alias("title")).join(t.labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.concat(X.shown_title("title"), F.coalesce(F.col("quality").cast("string"), F.lit("(unavailable)"))).alias("shown"))


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('3|' || doc_id), doc_id) AS r FROM documents) WHERE r <= 5".join(["SELECT printf('A%03d', row_number() OVER (ORDER BY md5('9|' || doc_id), doc_id)) AS item, doc_id FROM (", ")"]))
def numbered_items(t):
    """A drawn trial in a fixed random order, numbered A001, A002, ..."""
    drawn = trials.quota(t.documents.select("lang", "doc_id"), "lang", "doc_id", 5, "3")
    return drawn.select(F.format_string("A%03d", F.row_number().over(Window.orderBy(trials.lot("9", "doc_id"), "doc_id"))).alias("item"), "doc_id")

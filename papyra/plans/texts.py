"""Queries over texts: counts, normalisation, vocabulary, lots and costs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from papyra import store
from papyra.functions import text as X
from papyra.operators import batching, corpus, cost, ranking, topics, trials

from .registry import query

STOP, PHRASES = ["the", "and", "des", "les", "und", "los"], ["of the", "de la"]
FIXED = 137 + 8775 + 100
BY_LABEL = "SELECT CASE WHEN l_linenumber = 1 THEN 's' || l_suppkey ELSE 'p' || l_partkey || '.' || l_suppkey END AS label, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1"
NORM = (
    "list_filter(string_split_regex(regexp_replace(regexp_replace(replace(replace(lower(coalesce(text, '')), 'of the', ' '), 'de la', ' '), '[0-9][0-9.,]*', ' num ', 'g'), "
    "'[^a-zàâäçéèêëîïôöùûüÿñæœ]+', ' ', 'g'), ' '), lambda x: x <> '' AND length(x) >= 3 AND x NOT IN ('the','and','des','les','und','los','qu','jusqu','lorsqu','puisqu','quoiqu','aujourd','hui'))"
)


def label_counts(t):
    """Distinct articles per label: suppliers for main labels, parts of suppliers for side labels."""
    name = lambda *c: F.concat(*(x if not isinstance(x, str) else F.col(x).cast("string") for x in c))
    label = F.when(F.col("l_linenumber") == 1, name(F.lit("s"), "l_suppkey")).otherwise(name(F.lit("p"), "l_partkey", F.lit("."), "l_suppkey"))
    return t.lineitem.select("l_orderkey", label.alias("label")).distinct().groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT doc_id, len({w})::BIGINT AS n_words FROM documents WHERE len({w}) >= 10")
def word_count(t):
    return t.documents.select("doc_id", X.n_words("text").alias("n_words")).where("n_words >= 10")


@query("SELECT doc_id, {tok} AS n_tokens FROM documents")
def token_estimate(t):
    return t.documents.select("doc_id", X.n_tokens("text").alias("n_tokens"))


@query("SELECT doc_id, array_to_string(({w})[1:180], ' ') || CASE WHEN len({w}) > 180 THEN ' […]' ELSE '' END AS excerpt FROM documents")
def excerpt(t):
    return t.documents.select("doc_id", X.excerpt("text").alias("excerpt"))


@query(f"SELECT doc_id, array_to_string({NORM}, ' ') AS tokens_joined FROM documents")
def normalize_tokens(t):
    return t.texts("doc_id", "text").select("doc_id", F.array_join(X.normalised("text", STOP, PHRASES, 3), " ").alias("tokens_joined"))


@query("""
WITH RECURSIVE s AS (
  SELECT doc_id, {w} AS ws, len({w})::BIGINT AS n FROM documents
  UNION ALL
  SELECT doc_id, ws, greatest(floor(n * 0.8)::BIGINT, 1) FROM s WHERE n > 1 AND floor(length(array_to_string(ws[1:n], ' ')) / 3.5) + 1 > 60)
SELECT doc_id, min(n) AS n_words_kept FROM s GROUP BY 1""")
def truncate_budget(t):
    return t.documents.select("doc_id", X.truncated("text", 60).alias("n_words_kept"))


@query("SELECT q AS qcode, CASE WHEN instr(q, ':') > 0 THEN substr(q, instr(q, ':') + 1) ELSE q END AS code FROM (VALUES ('medtop:20000002'), ('a:b:c'), ('plain'), (':x'), ('')) v(q)")
def code_extract(t):
    rows = t.spark.createDataFrame([(q,) for q in ("medtop:20000002", "a:b:c", "plain", ":x", "")], "qcode string")
    return rows.select("qcode", X.code_of("qcode").alias("code"))


@query("SELECT q AS qcode, coalesce(nullif(o, ''), nullif(fr, ''), nullif(gb, ''), nullif(de, ''), '') AS label FROM (VALUES ('1','politique','politics',NULL,NULL), ('2','','war',NULL,NULL), ('3',NULL,NULL,'Sport',NULL), ('4',NULL,NULL,NULL,NULL), ('5','a','b','c','own')) v(q, fr, gb, de, o)")
def label_fallback(t):
    rows = [("1", {"fr": "politique", "en-GB": "politics"}), ("2", {"fr": "", "en-GB": "war"}), ("3", {"de": "Sport"}), ("4", {}), ("5", {"fr": "a", "en-GB": "b", "de": "c"})]
    return t.spark.createDataFrame(rows, "qcode string, names map<string,string>").select("qcode", X.label_of("names", "qcode", {"5": "own"}).alias("label"))


@query("""
WITH l AS (SELECT 'r' || r_regionkey AS code, r_name AS label, '' AS context FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'p' || p_partkey, p_name, p_brand FROM part)
SELECT code, code || ' ' || label || CASE WHEN count(*) OVER (PARTITION BY label) > 1 AND context <> '' THEN ' (' || context || ')' ELSE '' END AS line FROM l""")
def label_disambiguation(t):
    """A label shows its parent only where another concept has the same one."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("code")
    own = t.region.select(key("r", "r_regionkey"), F.col("r_name").alias("label"), F.lit("").alias("context"))
    nations = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(key("n", "n_nationkey"), F.col("n_name"), F.col("r_name"))
    every = own.union(nations).union(t.part.select(key("p", "p_partkey"), "p_name", "p_brand"))
    twice = every.groupBy("label").agg((F.count("*") > 1).alias("twice"))
    shown = F.when(F.col("twice") & (F.col("context") != ""), F.concat(F.lit(" ("), "context", F.lit(")"))).otherwise("")
    return every.join(twice, "label").select("code", F.concat("code", F.lit(" "), "label", shown).alias("line"))


@query("SELECT event_type, count(*) AS n_calls, sum(coalesce((props->>'$.k')::BIGINT, 0))::BIGINT AS tokens FROM events GROUP BY 1")
def json_usage(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n_calls"), F.sum(F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0))).alias("tokens"))


@query("""
SELECT event_type, sum(ok)::BIGINT AS valid, sum(1 - ok)::BIGINT AS invalid FROM (SELECT event_type,
  CASE WHEN json_keys(props) = ['k'] AND (props->>'$.k')::BIGINT BETWEEN 10 AND 90 THEN 1 ELSE 0 END AS ok FROM events) GROUP BY 1""")
def json_validate(t):
    """A strict schema: exactly one key, within its bounds."""
    ok = (F.json_object_keys("props") == F.array(F.lit("k"))) & F.get_json_object("props", "$.k").try_cast("long").between(10, 90)
    ok = F.coalesce(ok, F.lit(False))
    return t.events.groupBy("event_type").agg(F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))


@query(f"SELECT lang, count(*) FILTER (n = 0) AS n_empty, count(*) FILTER (n > 0 AND n < 20) AS n_short, count(*) FILTER (n >= 20) AS n_kept FROM (SELECT lang, len({NORM}) AS n FROM documents) GROUP BY 1")
def corpus_filter_report(t):
    n = t.texts("lang", "text").select("lang", F.size(X.normalised("text", STOP, PHRASES, 3)).alias("n"))
    return n.groupBy("lang").agg(
        F.count_if(F.col("n") == 0).alias("n_empty"), F.count_if((F.col("n") > 0) & (F.col("n") < 20)).alias("n_short"), F.count_if(F.col("n") >= 20).alias("n_kept")
    )


@query(f"""
WITH d AS (SELECT doc_id, {NORM} AS ws FROM documents), e AS (SELECT doc_id, unnest(ws) AS w FROM d WHERE len(ws) >= 20),
v AS (SELECT w FROM e GROUP BY 1 HAVING count(*) >= 5)
SELECT doc_id, count(*) AS n_before, count(v.w) AS n_after FROM e LEFT JOIN v USING (w) GROUP BY 1 HAVING count(v.w) >= 20""")
def min_freq_vocab(t):
    """Token occurrences, not documents, decide; the length filter is applied again."""
    docs = t.texts("doc_id", "text").select("doc_id", X.normalised("text", STOP, PHRASES, 3).alias("words")).where(F.size("words") >= 20)
    words = topics.counted(docs, "words", "doc_id")
    vocab = words.groupBy("word").agg(F.sum("n").alias("f")).where("f >= 5").select("word", F.lit(True).alias("keep"))
    both = words.join(vocab, "word", "left").groupBy("doc_id").agg(F.sum("n").alias("n_before"), F.sum(F.when(F.col("keep"), F.col("n")).otherwise(0)).alias("n_after"))
    return both.where("n_after >= 20")


@query(f"""
WITH d AS (SELECT doc_id, {NORM} AS ws FROM documents), e AS (SELECT doc_id, unnest(ws) AS w FROM d WHERE len(ws) >= 20),
v AS (SELECT w FROM e GROUP BY 1 HAVING count(*) >= 5), k AS (SELECT doc_id, count(*) AS n FROM e WHERE w IN (SELECT w FROM v) GROUP BY 1 HAVING count(*) >= 20)
SELECT (SELECT count(*) FROM d WHERE len(ws) = 0) AS n_empty, (SELECT count(*) FROM d WHERE len(ws) BETWEEN 1 AND 19) AS n_short, (SELECT count(*) FROM k) AS n_kept,
  (SELECT count(*) FROM d WHERE len(ws) >= 20) - (SELECT count(*) FROM k) AS n_rare, (SELECT count(DISTINCT w) FROM e WHERE doc_id IN (SELECT doc_id FROM k) AND w IN (SELECT w FROM v)) AS vocabulary""")
def corpus_report(t):
    """A corpus by its setting, and what its filters took."""
    setting = corpus.Setting("article", tuple(STOP), tuple(PHRASES), min_len=3, min_freq=5)
    return corpus.build(t.texts("doc_id", "text"), setting)[1]


@query("SELECT doc_id, len(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '\\p{L}{3,}') AND x NOT IN ('the', 'and', 'des', 'les', 'und', 'los')))::BIGINT AS n FROM documents")
def class_words(t):
    """Words that count for the words of a class."""
    return t.documents.select("doc_id", F.size(X.class_words("text", STOP)).cast("long").alias("n"))


@query("SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (text <> '') AS text, array_to_string(list_sort(list_distinct(list(role))), ',') AS roles FROM conversations GROUP BY 1 HAVING trim(coalesce(string_agg(text, ''), '')) <> ''")
def article_assembly(t):
    """Blocks joined in their order by a blank line; blank articles go."""
    parts = F.sort_array(F.collect_list(F.when(F.col("text") != "", F.struct("turn", "text"))))
    out = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"))
    return out.where(F.trim("text") != "")


@query("SELECT l_suppkey AS page, count(DISTINCT l_orderkey) AS n_articles FROM lineitem GROUP BY 1")
def articles_per_page(t):
    return t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("page")).distinct().groupBy("page").agg(F.count("*").alias("n_articles"))


@query("""
WITH w AS (SELECT lang, source, unnest(string_split_regex(lower(coalesce(text, '')), '[ \\t\\r\\n]+')) AS w FROM documents)
SELECT lang, source, count(DISTINCT w) AS "distinct", count(*) AS words, sum(length(w))::BIGINT AS chars FROM w WHERE w <> '' GROUP BY 1, 2""")
def vocab_per_page(t):
    words = t.texts("lang", "source", "text").select("lang", "source", F.explode(X.words(F.lower("text"))).alias("w"))
    per = words.groupBy("lang", "source", "w").agg(F.count("*").alias("n"))
    return per.groupBy("lang", "source").agg(F.count("*").alias("distinct"), F.sum("n").alias("words"), F.sum(F.col("n") * F.length("w")).alias("chars"))


@query("""
WITH w AS (SELECT DISTINCT source, unnest({w}) AS w FROM documents WHERE source IN ('src0', 'src1', 'src2')),
f AS (SELECT w, max((source = 'src0')::INT) AS a, max((source = 'src1')::INT) AS b, max((source = 'src2')::INT) AS c FROM w GROUP BY 1)
SELECT concat(a, b, c) AS zone, count(*) AS n FROM f GROUP BY 1
UNION ALL SELECT 'total0', sum(a)::BIGINT FROM f UNION ALL SELECT 'total1', sum(b)::BIGINT FROM f UNION ALL SELECT 'total2', sum(c)::BIGINT FROM f""")
def venn3_vocab(t):
    """One pass: three flags per word, counted by combination; totals add up the zones."""
    docs = t.texts("source", "text").where(F.col("source").isin("src0", "src1", "src2"))
    flag = lambda i: F.max((F.col("source") == f"src{i}").cast("int"))
    f = docs.select("source", F.explode(X.words("text")).alias("w")).groupBy("w").agg(flag(0).alias("a"), flag(1).alias("b"), flag(2).alias("c"))
    zones = f.groupBy("a", "b", "c").agg(F.count("*").alias("n"))
    rows = F.array(F.struct(F.concat("a", "b", "c").alias("zone"), F.col("n")), *(F.struct(F.lit(f"total{i}").alias("zone"), (F.col("n") * F.col(x)).alias("n")) for i, x in enumerate("abc")))
    return zones.select(F.explode(rows).alias("r")).groupBy("r.zone").agg(F.sum("r.n").alias("n"))


@query("""
WITH lex AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[ \\t\\r\\n]+')) AS w FROM benchmark),
w AS (SELECT doc_id, source, unnest(string_split_regex(lower(text), '[ \\t\\r\\n]+')) AS w FROM documents),
q AS (SELECT doc_id, source, avg(CASE WHEN w IN (SELECT w FROM lex) THEN 1.0 ELSE 0.0 END)::DOUBLE AS q FROM w WHERE w <> '' GROUP BY 1, 2)
SELECT source, count(*) AS n, round(avg(q), 6) AS mean, round(min(q), 6) AS min, round(max(q), 6) AS max FROM q GROUP BY 1""")
def quality_by_source(t):
    """Known-word ratio against a lexicon, per text, then per source."""
    lex = t.benchmark.select(F.explode(X.words(F.lower("text"))).alias("w")).distinct().withColumn("known", F.lit(1))
    words = t.texts("doc_id", "source", "text").select("doc_id", "source", F.explode(X.words(F.lower("text"))).alias("w"))
    q = words.join(lex, "w", "left").groupBy("doc_id", "source").agg(F.avg(F.coalesce("known", F.lit(0))).alias("q"))
    return q.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("q"), 6).alias("mean"), F.round(F.min("q"), 6).alias("min"), F.round(F.max("q"), 6).alias("max"))


@query(BY_LABEL)
def label_frequency(t):
    return label_counts(t)


@query(f"SELECT label FROM ({BY_LABEL}) WHERE n = 1")
def hapax_labels(t):
    return label_counts(t).where("n = 1").select("label")


@query(f"SELECT CASE WHEN n >= 1 AND n < 2 THEN 'hapax' WHEN n >= 2 AND n < 10 THEN 'rare' WHEN n >= 10 AND n < 100 THEN 'medium' WHEN n >= 100 THEN 'frequent' ELSE 'hapax' END AS band, count(*) AS n_labels, sum(n)::BIGINT AS n_uses FROM ({BY_LABEL}) GROUP BY 1")
def frequency_bands(t):
    return label_counts(t).groupBy(X.band("n").alias("band")).agg(F.count("*").alias("n_labels"), F.sum("n").alias("n_uses"))


@query(f"SELECT row_number() OVER w AS rank, label, n, (sum(n) OVER w / sum(n) OVER ())::DOUBLE AS cum_share FROM ({BY_LABEL}) WINDOW w AS (ORDER BY n DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def rank_frequency(t):
    at = ranking.cumulative(label_counts(t), [], [F.desc("n"), F.col("label")], "n")
    return at.select("rank", "label", "n", (F.col("upto") / F.col("all")).alias("cum_share"))


@query(f"SELECT min(rank) FILTER (n = 1) AS first_hapax, count(*) AS n_labels, (sum(n) FILTER (rank <= 20))::DOUBLE / sum(n) AS top20_share FROM (SELECT row_number() OVER (ORDER BY n DESC, label) AS rank, n FROM ({BY_LABEL}))")
def rank_tail(t):
    """Where the labels used once begin, and what the first twenty carry."""
    at = rank_frequency(t)
    return at.agg(F.min(F.when(F.col("n") == 1, F.col("rank"))).alias("first_hapax"), F.count("*").alias("n_labels"), (F.sum(F.when(F.col("rank") <= 20, F.col("n"))) / F.sum("n")).alias("top20_share"))


@query("SELECT doc_id, len(list_filter(({w})[1:10], lambda x: length(x) <= 2)) >= 5 AS is_noise FROM documents")
def noise_topics(t):
    return t.documents.select("doc_id", X.is_noise(X.words("text")).alias("is_noise"))


_STATS = "SELECT '{0}' AS measure, min({0})::DOUBLE AS min, max({0})::DOUBLE AS max, round(avg({0}), 6) AS mean, median({0})::DOUBLE AS median FROM x"


def _stats(df, columns):
    """Exact medians come from counts of the values, so no group is held in one state."""
    long = df.select(F.stack(F.lit(len(columns)), *(y for c in columns for y in (F.lit(c), F.col(c).cast("double")))).alias("measure", "v"))
    long = store.written(long.groupBy("measure", "v").agg(F.count("*").alias("n")), "values")
    mean = F.round(F.sum(F.col("v") * F.col("n")) / F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), 6)
    rest = long.groupBy("measure").agg(F.min("v").alias("min"), F.max("v").alias("max"), mean.alias("mean"))
    return rest.join(ranking.weighted_quantiles(long, ["measure"], "v", "n").select("measure", "median"), "measure")


@query("WITH x AS (SELECT len({w}) AS n_words, {tok} AS n_tokens, n_chars FROM documents) " + " UNION ALL ".join(_STATS.replace("{0}", c) for c in ("n_words", "n_tokens", "n_chars")))
def stats_summary(t):
    return _stats(t.documents.select(X.n_words("text").alias("n_words"), X.n_tokens("text").alias("n_tokens"), "n_chars"), ["n_words", "n_tokens", "n_chars"])


@query("WITH x AS (SELECT source, sum(len({w})) AS n_words, sum({tok}) AS n_tokens, sum(n_chars) AS n_chars FROM documents GROUP BY 1) " + " UNION ALL ".join(_STATS.replace("{0}", c) for c in ("n_words", "n_tokens", "n_chars")))
def stats_two_level(t):
    per = t.documents.groupBy("source").agg(F.sum(X.n_words("text")).alias("n_words"), F.sum(X.n_tokens("text")).alias("n_tokens"), F.sum("n_chars").alias("n_chars"))
    return _stats(per, ["n_words", "n_tokens", "n_chars"])


@query("""
SELECT o_orderpriority AS class, (list_sort(list(o_totalprice)))[count(*) // 2 + 1] AS median_hi,
  count(*) FILTER (o_totalprice < 0.5 * (SELECT max(o_totalprice) FROM orders)) / count(*)::DOUBLE AS low_share FROM orders GROUP BY 1""")
def upper_median(t):
    """By rank and count, so that no class is collected into one row or sorted by one task."""
    orders = t.orders.select(F.col("o_orderpriority").alias("class"), F.col("o_totalprice").alias("v"))
    top = orders.agg(F.max("v").alias("top"))
    low = orders.crossJoin(F.broadcast(top)).groupBy("class").agg((F.count_if(F.col("v") < 0.5 * F.col("top")) / F.count("*")).alias("low_share"))
    return ranking.quantiles(orders, ["class"], "v").select("class", F.col("upper").alias("median_hi")).join(low, "class")


@query("SELECT event_type AS type, round(sum(value), 4) AS total, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM events WHERE value <> 0 GROUP BY 1")
def latency_stats(t):
    v = F.col("value")
    rows = t.events.where("value <> 0").select(F.col("event_type").alias("type"), "value")
    rest = rows.groupBy("type").agg(F.round(F.sum(v), 4).alias("total"), F.min(v).alias("min"), F.max(v).alias("max"), F.round(F.avg(v), 6).alias("mean"))
    return rest.join(ranking.quantiles(rows, ["type"], "value").select("type", F.round("median", 6).alias("median")), "type")


_CACHE = "((1 - 0.554::DOUBLE) + 0.554::DOUBLE * 0.1::DOUBLE)"
_COST_SQL = f"""
WITH x AS (SELECT doc_id, source, {{tok}} AS a, 137 / 1e6::DOUBLE * 0.5::DOUBLE AS p, (8775 + 50) / 1e6::DOUBLE * 0.5::DOUBLE AS l FROM documents),
y AS (SELECT doc_id, source, p AS prompt_nc, p * {_CACHE} AS prompt_c, l AS list_nc, l * {_CACHE} AS list_c, a / 1e6::DOUBLE * 0.5::DOUBLE AS article,
  12 / 1e6::DOUBLE * 1.5::DOUBLE AS out_min, 31 / 1e6::DOUBLE * 1.5::DOUBLE AS out_typ, 48 / 1e6::DOUBLE * 1.5::DOUBLE AS out_max FROM x),
z AS (SELECT *, prompt_nc + list_nc + article + out_min AS total_nc_min, prompt_nc + list_nc + article + out_typ AS total_nc, prompt_nc + list_nc + article + out_max AS total_nc_max,
  prompt_c + list_c + article + out_min AS total_c_min, prompt_c + list_c + article + out_typ AS total_c, prompt_c + list_c + article + out_max AS total_c_max FROM y)
"""
_MEASURES = ["prompt_nc", "prompt_c", "list_nc", "list_c", "article", "out_min", "out_typ", "out_max", "total_nc_min", "total_nc", "total_nc_max", "total_c_min", "total_c", "total_c_max"]


@query(_COST_SQL + "SELECT doc_id, " + ", ".join(f"round({m}, 9) AS {m}" for m in _MEASURES) + " FROM z")
def cost_per_article(t):
    c = cost.call_cost(X.n_tokens("text"))
    return t.documents.select("doc_id", *(F.round(c[m], 9).alias(m) for m in _MEASURES))


@query(_COST_SQL + "SELECT source, count(*) AS n, " + ", ".join(f"round(sum({m}), 9) AS {m}" for m in _MEASURES) + " FROM z GROUP BY 1")
def cost_by_group(t):
    c = cost.call_cost(X.n_tokens("text"))
    return t.documents.groupBy("source").agg(F.count("*").alias("n"), *(F.round(F.sum(c[m]), 9).alias(m) for m in _MEASURES))


@query(f"""
WITH p(model, pin, pout) AS (VALUES {', '.join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE)" for m, a, b in cost.PRICES)}), d AS (SELECT count(*) AS n, sum({{tok}}) AS a FROM documents)
SELECT model, round((n * 8962 + a) / 1e6 * pin + n * 31 / 1e6 * pout, 6) AS total_nc, round((n * 8962 * {_CACHE} + a) / 1e6 * pin + n * 31 / 1e6 * pout, 6) AS total_c FROM p, d""")
def cost_by_model(t):
    """Token sums first: the price list then meets one row."""
    sums = t.documents.agg(F.count("*").alias("n"), F.sum(X.n_tokens("text")).alias("a"))
    prices = t.spark.createDataFrame(list(cost.PRICES), "model string, pin double, pout double")
    f = F.lit(137 + 8775 + 50)
    out = F.col("n") * cost.TYPICAL_OUTPUT / 1e6 * F.col("pout")
    total = lambda share: F.round((F.col("n") * f * F.lit(share) + F.col("a")) / 1e6 * F.col("pin") + out, 6)
    return prices.crossJoin(F.broadcast(sums)).select("model", total(1.0).alias("total_nc"), total(cost.CACHED_SHARE).alias("total_c"))


_LOTS = f"""
WITH RECURSIVE a AS (SELECT source, doc_id, {{tok}} AS tok, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents),
f AS (SELECT source, doc_id, tok, pos, 0::BIGINT AS lot, {FIXED} + tok + 15 AS used, 1 AS items FROM a WHERE pos = 1
  UNION ALL
  SELECT a.source, a.doc_id, a.tok, a.pos, f.lot + (f.used + a.tok + 15 > 40000 OR f.items >= 25)::BIGINT,
    CASE WHEN f.used + a.tok + 15 > 40000 OR f.items >= 25 THEN {FIXED} ELSE f.used END + a.tok + 15,
    CASE WHEN f.used + a.tok + 15 > 40000 OR f.items >= 25 THEN 1 ELSE f.items + 1 END
  FROM f JOIN a ON a.source = f.source AND a.pos = f.pos + 1)
"""


def _lots(t):
    return batching.with_lots(t.documents.select("source", "doc_id", X.n_tokens("text").alias("tok")), "source", "doc_id", "tok", FIXED)


@query(_LOTS + "SELECT source, doc_id, lot FROM f")
def greedy_batches(t):
    return _lots(t).select("source", "doc_id", "lot")


@query(_LOTS + f", g AS (SELECT source, lot, count(*) AS n, sum(tok)::BIGINT AS tokens FROM f GROUP BY 1, 2) SELECT source, lot, n, tokens, round(({FIXED} + tokens) / 1e6 * 0.5 + n * 31 / 1e6 * 1.5, 5) AS cost_nc, round(({FIXED} * {_CACHE} + tokens) / 1e6 * 0.5 + n * 31 / 1e6 * 1.5, 5) AS cost_c FROM g")
def cost_per_batch(t):
    g = _lots(t).groupBy("source", "lot").agg(F.count("*").alias("n"), F.sum("tok").alias("tokens"))
    return g.select("source", "lot", "n", "tokens", *(F.round((FIXED * s + F.col("tokens")) / 1e6 * 0.5 + F.col("n") * cost.TYPICAL_OUTPUT / 1e6 * 1.5, 5).alias(c) for c, s in (("cost_nc", 1.0), ("cost_c", cost.CACHED_SHARE))))


@query("SELECT source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 25 AS chunk, doc_id FROM documents".join(["SELECT source, chunk, count(*) AS n FROM (", ") GROUP BY 1, 2"]))
def fixed_chunks(t):
    """How many items each chunk of 25 has; which ones is a matter of their order alone."""
    return batching.chunk_sizes(t.documents, "source")


@query(f"SELECT lang, count(*) AS n, ceil(count(*) / least(25, greatest(1, floor((40000 - {FIXED}) / (avg({{tok}}) + 15)))))::BIGINT AS n_lots FROM documents GROUP BY 1")
def batch_count_estimate(t):
    g = t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.avg(X.n_tokens("text")).alias("mean"))
    return g.select("lang", "n", batching.lots_needed(F.col("n"), F.col("mean"), FIXED).alias("n_lots"))


@query("SELECT event_type AS type, round(sum(value - coalesce((props->>'$.k')::BIGINT, 0)) / 1e6 * 0.5 + sum(coalesce((props->>'$.k')::BIGINT, 0)) / 1e6 * 0.5 * 0.1, 9) AS cost FROM events GROUP BY 1")
def usage_cost(t):
    """Cached tokens at a tenth of the price."""
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0))
    return t.events.groupBy(F.col("event_type").alias("type")).agg(F.round(F.sum(F.col("value") - k) / 1e6 * 0.5 + F.sum(k) / 1e6 * 0.5 * 0.1, 9).alias("cost"))


@query(f"SELECT n, round({FIXED} / 1e6 * 0.5 / n + b, 9) AS cost FROM (SELECT unnest(range(1, 26)) AS n), (SELECT avg({{tok}}) / 1e6 * 0.5 + 31 / 1e6 * 1.5 AS b FROM documents)")
def amortisation_curve(t):
    b = t.documents.agg((F.avg(X.n_tokens("text")) / 1e6 * 0.5 + cost.TYPICAL_OUTPUT / 1e6 * 1.5).alias("b"))
    return t.spark.range(1, 26).toDF("n").crossJoin(F.broadcast(b)).select("n", F.round(FIXED / 1e6 * 0.5 / F.col("n") + F.col("b"), 9).alias("cost"))


_TW = """
WITH w AS (SELECT source, doc_id, unnest({w}) AS word FROM documents), c AS (SELECT source, word, count(*) AS n FROM w GROUP BY 1, 2),
tp AS (SELECT source AS topic, word, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, word) AS rank FROM c) WHERE rank <= 10)
"""


def _words(t):
    """(source, doc_id, word, n): one pass over the texts, for all that a query asks of their words."""
    return topics.counted(t.texts("source", "doc_id", "text").select("source", "doc_id", X.words("text").alias("words")), "words", "source", "doc_id")


def _topics(t, words=None):
    return topics.top_words(_words(t) if words is None else words, "source").select(F.col("source").alias("topic"), "word", "rank")


@query(_TW + ", p AS (SELECT word, count(*) AS n FROM tp GROUP BY 1) SELECT count(*) / sum(n)::DOUBLE AS diversity, count(*) AS unique_words, sum(n)::BIGINT AS total, count(*) FILTER (n > 1) AS n_shared FROM p")
def topic_diversity(t):
    return topics.diversity(_topics(t))


@query(_TW + """, dw AS (SELECT DISTINCT doc_id, word FROM w), n AS (SELECT count(DISTINCT doc_id) AS n FROM dw), s AS (SELECT word, count(*) AS n FROM dw GROUP BY 1),
v AS (SELECT * FROM dw WHERE word IN (SELECT word FROM tp)),
b AS (SELECT x.word AS w1, y.word AS w2, count(*) AS n12 FROM v x JOIN v y ON x.doc_id = y.doc_id AND x.word < y.word GROUP BY 1, 2),
q AS (SELECT x.topic, s1.n / n.n::DOUBLE AS p1, s2.n / n.n::DOUBLE AS p2, b.n12 / n.n::DOUBLE AS p12 FROM tp x JOIN tp y ON x.topic = y.topic AND x.word < y.word
  LEFT JOIN s s1 ON s1.word = x.word LEFT JOIN s s2 ON s2.word = y.word LEFT JOIN b ON w1 = x.word AND w2 = y.word, n)
SELECT topic, round_even(avg(CASE WHEN coalesce(p12, 0) < 1e-10 OR coalesce(p1, 0) < 1e-10 OR coalesce(p2, 0) < 1e-10 THEN -1 WHEN p12 = 1 THEN 1 ELSE greatest(-1, least(1, ln(p12 / (p1 * p2)) / -ln(p12))) END), 4) AS npmi FROM q GROUP BY 1""")
def topic_npmi(t):
    words = _words(t)
    top = store.written(_topics(t, words), "top")
    n = words.select("doc_id").distinct().count()
    return topics.npmi(top, words.select(F.col("doc_id").alias("doc"), "word"), n)


_RUN = """
WITH w AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE 'y' END AS run, source, unnest({w}) AS word FROM documents), c AS (SELECT run, source, word, count(*) AS n FROM w GROUP BY 1, 2, 3),
tp AS (SELECT run, source AS topic, word FROM (SELECT *, row_number() OVER (PARTITION BY run, source ORDER BY n DESC, word) AS rank FROM c) WHERE rank <= 10)
"""


@query(_RUN + """, s AS (SELECT run, topic, count(*) AS n FROM tp GROUP BY 1, 2), b AS (SELECT x.topic AS a, y.topic AS b, count(*) AS n FROM tp x JOIN tp y ON x.word = y.word AND x.run = 'x' AND y.run = 'y' GROUP BY 1, 2)
SELECT b.a, b.b, b.n / (p.n + q.n - b.n)::DOUBLE AS jaccard FROM b JOIN s p ON p.run = 'x' AND p.topic = b.a JOIN s q ON q.run = 'y' AND q.topic = b.b""")
def run_overlaps(t):
    """The topics of two runs (here: two halves of the corpus) by the words that they share."""
    return topics.overlaps(*_two_runs(t))


def _two_runs(t):
    words = _words(t)
    half = lambda i: topics.top_words(words.where(F.col("doc_id") % 2 == i), "source").select(F.col("source").alias("topic"), "word")
    return half(0), half(1)


@query()
def run_stability(t):
    """Topics of two runs, matched one to one by falling overlap."""
    return t.spark.createDataFrame(topics.stability(*_two_runs(t)), "a string, b string, jaccard double")


@query(_TW + ", v AS (SELECT DISTINCT unnest({w}) AS word FROM benchmark) SELECT topic, count(*) FILTER (v.word IS NULL) AS oov, count(*) AS total FROM tp LEFT JOIN v USING (word) GROUP BY 1")
def oov_top_words(t):
    vocab = t.benchmark.select(F.explode(X.words("text")).alias("word")).distinct().withColumn("known", F.lit(True))
    return _topics(t).join(vocab, "word", "left").groupBy("topic").agg(F.count_if(F.col("known").isNull()).alias("oov"), F.count("*").alias("total"))


@query("""
WITH c AS (SELECT source, word, count(*) AS n FROM (SELECT source, unnest({w}) AS word FROM documents) GROUP BY 1, 2), f AS (SELECT word, sum(n) AS f FROM c GROUP BY 1),
s AS (SELECT source, sum(n) AS size FROM c GROUP BY 1), x AS (SELECT source, word, n / size::DOUBLE * ln(1 + (SELECT avg(size) FROM s) / f::DOUBLE) AS score FROM c JOIN f USING (word) JOIN s USING (source))
SELECT source, rank, word, round(score, 10) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 12) DESC, word) AS rank FROM x) WHERE rank <= 10""")
def ctfidf_top_words(t):
    return topics.ctfidf(_words(t), "source").select("source", F.col("rank").cast("long").alias("rank"), "word", F.round("score", 10).alias("score"))


@query(_TW + """, o AS (SELECT DISTINCT word FROM tp WHERE rank <= 5), pl AS (SELECT word, row_number() OVER (ORDER BY md5('5|' || word), word) - 1 AS place, count(*) OVER () AS size FROM o),
m AS (SELECT topic, count(*) AS mine FROM tp JOIN o USING (word) GROUP BY 1),
st AS (SELECT topic, size, ('0x' || substr(md5('5|' || topic), 1, 15))::BIGINT % size AS start, unnest(range(0, least(mine, size - 1) + 1)) AS step FROM m, (SELECT max(size) AS size FROM pl)),
ca AS (SELECT st.topic, step, pl.word FROM st JOIN pl ON pl.place = (start + step) % st.size WHERE NOT EXISTS (SELECT 1 FROM tp WHERE tp.topic = st.topic AND tp.word = pl.word)),
intr AS (SELECT topic, arg_min(word, step) AS intruder FROM ca GROUP BY 1),
kept AS (SELECT topic, word FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY md5('5w|' || topic || '|' || word), word) AS r FROM tp WHERE topic IN (SELECT topic FROM intr)) WHERE r <= 5),
a AS (SELECT * FROM kept UNION ALL SELECT * FROM intr),
p AS (SELECT topic, word, row_number() OVER (PARTITION BY topic ORDER BY md5('5p|' || topic || '|' || word), word) AS p FROM a)
SELECT p.topic, string_agg(word, ' ' ORDER BY p) AS words, intruder, (max(p) FILTER (word = intruder))::INT AS position FROM p JOIN intr USING (topic) GROUP BY p.topic, intruder""")
def intrusion_items(t):
    """Five words of each topic by lot, and one of another topic's first five."""
    items = trials.intrusion(store.written(_topics(t), "top"), "5")
    return items.select("topic", F.array_join("words", " ").alias("words"), "intruder", "position")


@query("SELECT doc_id, round(least(1, 512 / {tok}::DOUBLE), 9) AS share, nullif(regexp_extract('X000' || regexp_extract(source, '([0-9]+)', 1), 'X0*([0-9]+)', 1), '')::INT AS page_no FROM documents")
def encoded_share(t):
    name = F.concat(F.lit("X000"), F.regexp_extract("source", "([0-9]+)", 1))
    return t.documents.select("doc_id", F.round(F.least(F.lit(1.0), F.lit(512) / X.n_tokens("text")), 9).alias("share"), X.page_number(name).alias("page_no"))


@query("""
WITH x AS (SELECT lang, count(*) AS n, sum({tok})::BIGINT AS a FROM documents GROUP BY 1)
SELECT 'single' AS scenario, lang, n AS n_calls, round((n * 9012 + a) / 1e6 * 0.5 + n * 12 / 1e6 * 1.5, 6) AS cost_min, round((n * 9012 + a) / 1e6 * 0.5 + n * 48 / 1e6 * 1.5, 6) AS cost_max FROM x
UNION ALL SELECT 'batched', lang, ceil(n / 25.0)::BIGINT, round((ceil(n / 25.0) * 9012 + a) / 1e6 * 0.5 + n * 12 / 1e6 * 1.5, 6), round((ceil(n / 25.0) * 9012 + a) / 1e6 * 0.5 + n * 48 / 1e6 * 1.5, 6) FROM x
UNION ALL SELECT 'cascade', lang, 2 * ceil(n / 25.0)::BIGINT, round((2 * ceil(n / 25.0) * 1200 + 2 * a) / 1e6 * 0.5 + n * 24 / 1e6 * 1.5, 6), round((2 * ceil(n / 25.0) * 1200 + 2 * a) / 1e6 * 0.5 + n * 96 / 1e6 * 1.5, 6) FROM x""")
def scenario_union(t):
    x = t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.sum(X.n_tokens("text")).alias("a"))
    lots = F.ceil(F.col("n") / 25.0).cast("long")
    rows = [cost.scenario(name, calls, fixed, reads, out) for name, calls, fixed, reads, out in (("single", F.col("n"), 9012, 1, 1), ("batched", lots, 9012, 1, 1), ("cascade", 2 * lots, 1200, 2, 2))]
    return x.select("lang", F.explode(F.array(*rows)).alias("r")).select("r.scenario", "lang", "r.n_calls", "r.cost_min", "r.cost_max")

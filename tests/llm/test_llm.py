"""Operators of papyra.llm against brute force, the libraries, or held-out data."""

import collections
import hashlib
import itertools
import math
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from llm_brute import brute_jaccard
from pyspark.sql import functions as F

from papyra.llm import ann, components, decontaminate, language_id, markov, mixing, repeats, sharding, simhash, toxicity
from papyra.llm import text as tx
from papyra.llm import tokens as tk
from papyra.llm.queries import ORACLES, QUERIES, VOCABULARY
from papyra.llm.xxh import hash_spans

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
BPE = public_tokenizers.path(VOCABULARY)
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, h long, fp long, bucket long, size long, target int, taken int, shard string, th long, toxic int, n_items int, k string, key int"

PASSAGE = " ".join(f"mot{i}" for i in range(60))
TEXTS = [
    (1, PASSAGE + " fin un", "fr", "a"), (2, "debut " + PASSAGE, "fr", "b"), (2, "debut " + PASSAGE, "fr", "b"), (3, None, "en", None), (4, "", "en", "a"), (5, " \t\n", None, "a"), (None, "no id here", "en", "a"),
    (6, "x " * 40_000, "en", "c"), (7, "the cat!! IDIOT <|endoftext|> 123", "en", "c"), (8, "the cat!! IDIOT <|endoftext|> 123", "en", "c"), (9, "été 日本語 😀 \x85 a b", "de", "é"), (10, PASSAGE, "fr", "b"), (11, "w" * 5000, "en", ""),
]


@pytest.fixture(scope="module")
def hostile(spark):
    pad = [1, 0.5, 2, 3, 4, 5, 6, 7, "s", 8, 1, 9, "k", 1]
    return spark.createDataFrame([(*t, *pad) for t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [tuple(r) for r in df.collect()]


def words(s):
    return (s or "").encode().split()


def test_hashes_stay_where_the_word_stands():
    buf = np.frombuffer("ab été ab\tx ab".encode(), np.uint8)
    s, e, r = tx.words(buf, np.array([0, 5, len(buf)]))
    h = tx.word_hashes(buf, s, e)
    assert h[0] == h[-1] == tx.hash_word(b"ab") and len(set(r.tolist())) == 2
    rng = np.random.default_rng(0)
    buf = rng.integers(0, 256, 20_000).astype(np.uint8)
    s = rng.integers(0, 19_000, 3000)
    e = s + rng.integers(0, 90, 3000)
    assert [int(x) for x in hash_spans(buf, s, e)] == [xxhash.xxh64_intdigest(buf[a:b].tobytes(), 42) for a, b in zip(s, e)]


def test_language_id_held_out(spark):
    got = QUERIES["op1_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_language_id_is_naive_bayes(spark):
    texts = [("the cat and the dog", "en"), ("le chat et la mer", "fr"), ("un été à la plage", "fr")]
    model = language_id.fit(spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(texts)], "doc_id long, text string, lang string"))
    assert model[0] == ["en", "fr"]
    counts = {g: collections.Counter() for g in model[0]}

    def grams(t):
        t = "".join(c if c.isalpha() else " " for c in t.lower())
        cps = np.array([ord(c) for c in " ".join(t.split(" "))], np.uint32)
        return [int(x) for at, _ in language_id.grams(cps, np.zeros(len(cps), int)) for x in at]

    for t, g in texts:
        counts[g].update(grams(t))
    for j, g in enumerate(model[0]):
        total = sum(counts[g].values()) + language_id.SMOOTHING * language_id.BUCKETS
        for b in list(counts[g])[:20]:
            assert model[1][b, j] == pytest.approx(math.log((counts[g][b] + language_id.SMOOTHING) / total))


def test_language_id_edges(hostile, empty):
    got = language_id.predict(hostile, language_id.fit(hostile)).collect()
    assert len(got) == len(TEXTS) and all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (3, 4, 5))
    assert rows(language_id.predict(empty, language_id.fit(empty))) == []
    assert {r.lang_pred for r in language_id.predict(hostile, language_id.fit(empty)).collect()} == {"und"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = c.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(rows(df.select(*cols))) == sorted(tuple(dict(zip(names, r))[x] for x in cols) for r in cur.fetchall())


def test_mix_properties(hostile, empty, spark):
    got = mixing.mix(hostile, ["doc_id"]).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.taken <= 3 * r.size for r in got)
    by = collections.defaultdict(lambda: [0, 0.0])
    for r in got:
        by[r.source_size, r.target][0] += r.taken
    assert all(abs(t - target) <= 1 for (_, target), (t, _) in by.items())
    assert rows(mixing.mix(empty, ["doc_id"])) == []
    again = mixing.mix(hostile.repartition(5), ["doc_id"], bin_rows=1).collect()
    assert sorted((r.doc_id or 0, r.size, r.taken) for r in got) == sorted((r.doc_id or 0, r.size, r.taken) for r in again)
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("w"), (F.col("id") % 9 + 1).cast("int"))).alias("text"), F.when(F.col("id") % 3 > 0, "a").when(F.col("id") % 5 > 0, "b").otherwise("c").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    mixed = mixing.mix(mixing.packed(many), ["row"], size="_size", tie="_tie", bin_rows=64)
    want = mixed.agg(F.sum("taken")).first()[0]
    assert mixing.materialise(mixed).agg(F.sum(mixing.n_words("text"))).first()[0] == want


def test_markov_base_and_edges(spark, hostile, empty):
    for df in (spark.read.parquet(f"{SMALL}/documents.parquet"), hostile):
        data = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
        toks = [(i, [*(t or "").encode().translate(LOWER).split(), None]) for i, t in data]
        c = collections.Counter(w for i, ws in toks if not held(i) for w in ws)
        n, v = sum(c.values()), len(c)
        want = sorted((i or 0, held(i), len(ws), sum(w in c for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 4)) for i, ws in toks)
        got = markov.score(df, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1, passes=1).collect()
        assert sorted((r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert rows(markov.score(empty, F.lit(False))) == []


def test_markov_beats_the_base(spark):
    got = QUERIES["op3_hidden_markov"](spark, SF).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_toxicity(spark, hostile, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = QUERIES["op4_toxicity"](spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted for r in got if r.toxic) / sum(r.toxic for r in got)
    false = sum(r.predicted for r in got if not r.toxic) / sum(1 - r.toxic for r in got)
    assert hit > 0.8 and false < 0.02
    model = toxicity.fit(docs, labels)
    some = docs.limit(300)
    found = toxicity.offending(some, toxicity.score(some, model)).collect()
    assert found and all(r.sentence for r in found)
    scored = toxicity.score(hostile, model).collect()
    assert len(scored) == len(TEXTS) and all(r.score == 0 and r.predicted == 0 for r in scored if r.doc_id in (3, 4))
    assert {r.predicted for r in scored if r.doc_id in (7, 8)} == {1}
    kept = toxicity.without_toxic(hostile, model)
    assert kept.columns == hostile.columns and kept.count() == sum(1 - r.predicted for r in scored)
    assert toxicity.fit(empty, labels.limit(0)) is None and {r.score for r in toxicity.score(hostile, None).collect()} == {0}
    assert rows(toxicity.score(empty, model)) == []


def test_sharding(spark, hostile, empty):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat_ws("", F.array_repeat(F.lit("x"), (F.col("id") % 50).cast("int"))).alias("text"))
    docs = docs.union(spark.range(40).select(F.lit(7), F.lit("y" * 100))).union(spark.range(1).select(F.lit(1000), F.lit("z" * 5000)))
    got = sharding.shard(docs, ["doc_id"], limit=1000).collect()
    size = collections.defaultdict(list)
    for r in got:
        size[r.shard].append(r.n_bytes)
    assert len(got) == 541 and all(sum(x) <= 1000 or len(x) == 1 for x in size.values())
    names = [s.split(".")[0] for s in size]
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    assert len(sharding.shard(hostile, hostile.columns, limit=100).collect()) == len(TEXTS)
    assert rows(sharding.shard(empty, ["doc_id"])) == []


def brute_simhash(data, k=3):
    out = {}
    for i, t in data:
        w = (t or "").encode().translate(LOWER).split()
        h = np.array([xxhash.xxh64_intdigest(b" ".join(w[j : j + k]), 42) for j in range(max(1, len(w) - k + 1))] if w else [], np.uint64)
        out[i] = sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(h)) if len(h) else 0
    return out


def brute_groups(fps, bits=2):
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for a, b in itertools.combinations(ids, 2):
        if (fps[a] ^ fps[b]).bit_count() <= bits:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(spark, hostile, empty):
    for df in (spark.read.parquet(f"{SF}/documents.parquet"), hostile.where("doc_id IS NOT NULL")):
        data = dict((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
        fps = brute_simhash(data.items())
        groups = brute_groups(fps)
        got = simhash.near_duplicates(df).collect()
        assert len(got) == df.count() and all((r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", groups[r.doc_id]) for r in got)
    assert [r.component_id for r in simhash.near_duplicates(hostile).where("doc_id IS NULL").collect()] == [None]
    kept = simhash.one_of_each(hostile)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == hostile.columns and len(ids) == len(set(ids)) and None in ids and 3 in ids and 4 not in ids
    assert rows(simhash.near_duplicates(empty)) == []


def test_simhash_crowds(spark):
    """A signature with more fingerprints than are paired takes another way, and loses no link."""
    rng = np.random.default_rng(5)
    low = np.unique(np.concatenate([[0], *(np.uint64(1) << rng.integers(0, 32, (700, 2)).astype(np.uint64)).T]).astype(np.uint64))
    low = np.unique(np.concatenate([low, low[:, None].repeat(30, 1).ravel() ^ (np.uint64(1) << rng.integers(0, 32, len(low) * 30).astype(np.uint64))]))[:600]
    fps = {i: int(x) | (0xABCD1234 << 32) for i, x in enumerate(low)}
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in fps.items()], "doc_id long, fp long")
    links = simhash.links(df, len(fps))
    name = {x - (1 << 64) if x >> 63 else x: i for i, x in fps.items()}
    pairs = [(name[r.a], name[r.b]) for r in links.collect()]
    assert len(fps) > simhash.CROWD and all((fps[a] ^ fps[b]).bit_count() <= 2 for a, b in pairs)
    got = dict(rows(components.connected(spark.createDataFrame(pairs, "a long, b long"))))
    assert {i: got.get(i, i) for i in fps} == brute_groups(fps)


def test_signatures_report_each_link_once():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, i % 6, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    out = [list(simhash._signatures([pa.record_batch({"fp": v.view(np.int64)})])) for v in (x, y)]
    reports = sum(simhash._pairs(x, y, a.column("sig").to_numpy().view(np.uint64)) & (a.column("sig").to_numpy() == b.column("sig").to_numpy()) for a, b in zip(*out))
    assert reports.tolist() == [int(i % 6 <= 2) for i in range(400)]


def test_rows_that_repeat_a_key_are_told_apart_by_text(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    data = [(5, a), (5, b), (3, a), (3, a), (7, c), (7, c), (8, c + " more"), (None, a), (None, a), ((1 << 63) - 1, "d"), ((1 << 63) - 2, "e")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in data], "doc_id long, text string, th string, c0 string")
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    want = [(3, a), (5, b), (7, c), (None, a), (None, a), ((1 << 63) - 1, "d"), ((1 << 63) - 2, "e")]
    assert sorted(rows(kept.select("doc_id", "text")), key=str) == sorted(want, key=str)


def test_components_of_ids_near_the_largest(spark):
    top = (1 << 63) - 1
    pairs = [(top, top - 1), (top - 1, top - 2), (top - 2, top - 3), (-top, 5), (None, 4), (6, 6)]
    got = dict(rows(components.connected(spark.createDataFrame(pairs, "a long, b long"))))
    assert got == {**dict.fromkeys(range(top - 3, top + 1), top - 3), -top: -top, 5: -top}


def test_components_of_a_long_chain(spark):
    order = np.random.default_rng(1).permutation(200).tolist()
    got = dict(rows(components.connected(spark.createDataFrame(list(zip(order, order[1:])), "a long, b long"))))
    assert got == dict.fromkeys(range(200), 0)


def brute_nearest(vectors, k=20, every=20):
    out = {}
    for q, x in vectors.items():
        if q % every == 0:
            out[q] = sorted(((-float(np.dot(x, y)), i) for i, y in vectors.items() if i != q))[:k]
    return out


def test_nearest(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute_nearest({r.vec_id: np.array(r.embedding, float) for r in df.collect()})
    got = collections.defaultdict(dict)
    for r in ann.search(df).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    assert set(got) == set(want) and all(list(sorted(x)) == list(range(1, 21)) for x in got.values())
    recall = np.mean([len({v for v, _ in got[q].values()} & {i for _, i in want[q]}) / 20 for q in want])
    assert recall >= 0.9
    for q, x in got.items():
        line = [x[r] for r in range(1, 21)]
        assert line == sorted(line, key=lambda y: (-y[1], y[0]))


def test_nearest_edges(spark):
    rng = np.random.default_rng(0)
    same = [0.6, 0.8, 0.0, 0.0]
    data = [(i, same if i % 3 == 0 else [float(x) for x in rng.normal(size=4)]) for i in range(150)]
    data += [(200, None), (201, [0.0] * 4), (202, [1.0, None, 0.0, 0.0]), (203, [float("nan"), 0.0, 0.0, 1.0]), (204, [float("inf")] * 4), (220, [1.0]), (None, same), (40, data[40][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    want = brute_nearest({i: np.array(v) for i, v in data[:150]})
    got = {q: [r.vec_id for r in sorted(g, key=lambda r: r.rank)] for q, g in itertools.groupby(sorted(ann.search(df).collect(), key=lambda r: r.query_id), key=lambda r: r.query_id)}
    assert set(got) == set(want)
    assert got[0] == [i for i in range(3, 150, 3)][:20] or want[0][0][0] < -1.0001
    assert rows(ann.search(df.limit(0))) == []


def test_token_counts(spark, hostile, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    for df in (spark.read.parquet(f"{SMALL}/documents.parquet"), hostile):
        data = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
        want = sorted((i or 0, len(t.encode()), len(tok.encode(t, add_special_tokens=False).ids)) for i, t in data)
        got = tk.count_tokens(df, BPE).collect()
        assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want and all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert rows(tk.count_tokens(empty, BPE)) == []


def test_token_counter_agrees_on_odd_characters():
    with open(BPE, encoding="utf-8") as f:
        spec = f.read()
    c = tk.Counter(spec, tk.prove(spec), tk.unsafe_characters(spec))
    rng = np.random.default_rng(4)
    for _ in range(300):
        pool = [*map(chr, rng.integers(1, 0xD800, 6)), *map(chr, rng.integers(0xE000, 0x110000, 2)), " ", "\n", "'s", "a", "1", "!"]
        s = "".join(rng.choice(pool, 40))
        assert c.count(s) == len(c.tok.encode(s, add_special_tokens=False).ids)


def brute_repeats(data, size=50):
    least = {}
    for i, t in data:
        w = words(t)
        for j in range(len(w) - size + 1):
            k = tuple(w[j : j + size])
            least[k] = min(least.get(k, i), i)
    out = []
    for i, t in data:
        w = words(t)
        gone = set()
        for j in range(len(w) - size + 1):
            if least[tuple(w[j : j + size])] < i:
                gone.update(range(j, j + size))
        kept = [x for n, x in enumerate(w) if n not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


def test_automaton_locates_every_occurrence():
    rng = np.random.default_rng(9)
    texts = [[f"w{x}" for x in rng.integers(0, 3, n)] for n in (200, 3, 0, 90)]
    phrases = [" ".join(texts[0][i : i + 4]) for i in (5, 50, 51)] + ["w0 w0 w1 other"]
    buf = np.frombuffer(" ".join(" ".join(t) for t in texts).encode(), np.uint8)
    offs = np.cumsum([0, *(len(" ".join(t)) + 1 for t in texts)])
    offs[-1] = len(buf)
    starts, ends, of = tx.words(buf, offs)
    got = repeats.Automaton([p.encode() for p in phrases], 4).locate(tx.word_hashes(buf, starts, ends), of)
    flat = [w for t in texts for w in t]
    want = [i for i in range(len(flat) - 3) if of[i] == of[i + 3] and " ".join(flat[i : i + 4]) in phrases]
    assert sorted(set(got.tolist())) == want and len(want) > 5


@pytest.mark.parametrize("bucket", [1 << 12, 4 << 20])
def test_repeats(spark, hostile, empty, bucket):
    rng = np.random.default_rng(7)
    base = [[f"v{x}" for x in rng.integers(0, 5000, 300)] for _ in range(4)]
    made = []
    for i in range(60):
        b = base[rng.integers(4)]
        a, n = rng.integers(0, 200), rng.integers(40, 100)
        made.append((i, " ".join([*(f"u{x}" for x in rng.integers(0, 9000, 30)), *b[a : a + n], "a", "a", *["a"] * rng.integers(0, 130), *b[:55]])))
    # null ids with passages of others, a long text, and one key with many texts
    odd = hostile.select("doc_id", "text").union(spark.createDataFrame([(None, PASSAGE + " z"), (None, PASSAGE + " z"), *((20, f"{PASSAGE} {i}") for i in range(9)), (19, "x " * 70)], "doc_id long, text string"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7" if bucket > 1 << 12 else "10000")
    for df in (spark.createDataFrame(made, "doc_id long, text string"), spark.read.parquet(f"{SMALL}/documents.parquet"), odd):
        data = [(-1 if r.doc_id is None else r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        got = [(-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in repeats.remove_repeats(df, bucket_bytes=bucket).collect()]
        assert sorted(got) == brute_repeats(data)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rows(repeats.remove_repeats(empty)) == []


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps, names = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        nxt = corpus_pipeline.store.written(stage(spark, docs, SF), "test")
        assert nxt.columns == names or name == "sharding"
        steps[name] = (docs, nxt)
        docs = nxt
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = ({r.doc_id for r in d.collect()} for d in steps["toxicity"])
    gone = before - after
    assert sum(labels.get(i, 0) for i in gone) >= 0.8 * sum(labels[i] for i in before if i in labels) and sum(labels.get(i) == 0 for i in gone) <= 5
    before, after = steps["simhash near-dedup"]
    groups = brute_jaccard((r.doc_id, r.text) for r in before.collect())
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(groups.values()))
    before, after = steps["benchmark decontamination"]
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect() if not any(t in " ".join(r.text.split()) for t in items)}
    before, after = steps["source mixing"]
    assert abs(after.agg(F.sum(mixing.n_words("text"))).first()[0] - before.agg(F.sum(mixing.n_words("text"))).first()[0]) < 50
    size = steps["sharding"][1].groupBy("shard").agg(F.sum("n_bytes").alias("b"), F.countDistinct("doc_id").alias("n")).collect()
    assert all(r.b <= sharding.SHARD_BYTES or r.n == 1 for r in size)

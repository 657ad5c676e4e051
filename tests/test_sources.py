"""Markup and table readers on toy files."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from papyra.operators import topics
from papyra.sources import markup, runs, sinks, tables
from papyra.streaming import windows

ALTO = """<alto{ns}><Tags><StructureTag ID="T1" LABEL="Title"/></Tags><Layout><Page WIDTH="100" HEIGHT="200">
<TextBlock ID="B1" HPOS="10" VPOS="20" WIDTH="90" HEIGHT="40"><TextLine><String CONTENT="Le"/><SP/><String CONTENT="gouver-" SUBS_TYPE="HypPart1" SUBS_CONTENT="gouvernement"/></TextLine>
<TextLine><String CONTENT="nement" SUBS_TYPE="HypPart2" SUBS_CONTENT="gouvernement"/><String CONTENT="tombe"/></TextLine></TextBlock>
<TextBlock ID="B2" TAGREFS="T0 T1" HPOS="0" VPOS="0" WIDTH="5" HEIGHT="5"><TextLine><String CONTENT="TITRE"/></TextLine></TextBlock></Page></Layout></alto>"""
METS = """<m:mets xmlns:m="http://www.loc.gov/METS/" xmlns:x="http://www.w3.org/1999/xlink"><m:dmdSec ID="D1"><m:mods><m:title> Un titre </m:title></m:mods></m:dmdSec>
<m:fileSec><m:file ID="F1"><m:FLocat x:href="ocr/X0001.xml"/></m:file></m:fileSec>
<m:structMap TYPE="Logical"><m:div TYPE="ARTICLE" ID="A1" DMDID="D1"><m:div><m:area FILEID="F1" BEGIN="B2"/><m:area FILEID="F1" BEGIN="B1"/><m:area FILEID="F9" BEGIN="B1"/></m:div></m:div>
<m:div TYPE="Article" ID="A2" LABEL="Deux"><m:area FILEID="F1" BEGIN="B9"/></m:div></m:structMap>
<m:structMap TYPE="logical"><m:div TYPE="ARTICLE" ID="A3"><m:area FILEID="F1" BEGIN="B1"/></m:div></m:structMap></m:mets>"""


def files(spark, rows):
    return spark.createDataFrame(rows, "issue string, page string, content string")


def test_alto_in_any_name_space(spark):
    rows = [("i", f"X000{k}.xml", ALTO.format(ns=ns)) for k, ns in enumerate(["", ' xmlns="http://www.loc.gov/standards/alto/ns-v2#"', ' xmlns="http://www.loc.gov/standards/alto/ns-v3#"'])]
    got = markup.blocks(files(spark, [*rows, ("i", "bad", "<alto><x")]), ["page"]).collect()
    good = [r for r in got if r.error is None]
    assert len(good) == 6 and len(got) == 7
    assert {(r.block_id, r.text, r.lines, r.is_title) for r in good} == {("B1", "Le gouvernement tombe", "Le gouver-\nnement tombe", False), ("B2", "TITRE", "TITRE", True)}
    assert markup.blocks(files(spark, rows), ["page"], min_side=markup.MIN_SIDE).count() == 3
    assert sorted(r.token for r in markup.tokens(files(spark, rows[:1]), ["page"]).collect()) == ["gouver-", "le", "nement", "tombe"]


def test_articles(spark):
    toc = markup.toc(files(spark, [("i", "T.xml", METS)]), ["issue"])
    blocks = markup.blocks(files(spark, [("i", "X0001.xml", ALTO.format(ns=""))]), ["issue", "page"])
    got = {r.article_id: r for r in markup.articles(toc, blocks, "issue").collect()}
    assert set(got) == {"A1", "A3"}
    assert (got["A1"].title, got["A1"].text, got["A1"].pages) == ("Un titre", "TITRE\n\nLe gouver-\nnement tombe", ["X0001.xml"])
    assert got["A3"].title == "A3"
    first = markup.toc(files(spark, [("i", "T.xml", METS)]), ["issue"], first_map=True)
    assert {r.article_id for r in first.collect()} == {"A1", "A2"}
    assert markup.articles(first, blocks, "issue", "text").first().text == "TITRE Le gouvernement tombe"
    assert markup.articles_per_page(toc, "issue").first().n_articles == 3


def test_alto_rewrite(spark):
    for ns in ("", ' xmlns="http://www.loc.gov/standards/alto/ns-v3#"'):
        page = files(spark, [("i", "p", ALTO.format(ns=ns)), ("i", "q", ALTO.format(ns=ns))])
        texts = spark.createDataFrame([("p", "B1", "un deux\n\ntrois & <quatre>"), ("p", "B2", " ")], "page string, block_id string, text string")
        out = markup.rewritten(page, texts, ["page"])
        by = {(b.page, b.block_id): b for b in markup.blocks(out, ["page"]).collect()}
        assert by["p", "B1"].lines == "un deux\ntrois & <quatre>" and by["p", "B2"].lines == "TITRE" and by["p", "B2"].is_title
        assert by["q", "B1"].text == "Le gouvernement tombe"
        assert 'HPOS="55" VPOS="20" WIDTH="45" HEIGHT="20" CONTENT="deux"' in out.where("page = 'p'").first().content


def test_prefixed_names_and_page_texts(spark):
    xml = ALTO.format(ns="").replace("<alto>", '<a:alto xmlns:a="u">').replace("</alto>", "</a:alto>").replace("<TextBlock", "<a:TextBlock").replace("</TextBlock", "</a:TextBlock")
    got = markup.page_texts(files(spark, [("i", "p", xml), ("i", "q", "<alto/>"), ("j", "p", None)]), "issue", "page").collect()
    assert [(r.issue, r.pages) for r in got] == [("i", {"p": "Le gouver-\nnement tombe"})]


def test_scanned_toc(spark):
    broken = '<div ID="A1" X="" TYPE="ARTICLE" LABEL="Un"><area BEGIN="B1"/><area BEGIN="B2"><div ID="A2" X="" TYPE="ARTICLE" LABEL="Deux"><area BEGIN="B2"/>'
    got = markup.scanned_toc(files(spark, [("i", "t", broken)]), ["issue"])
    assert {(r.block_id, r.article_id, r.title) for r in got.collect()} == {("B1", "A1", "Un"), ("B2", "A2", "Deux")}
    geometry = markup.blocks(files(spark, [("i", "p", ALTO.format(ns=""))]), ["issue", "page"])
    themes = spark.createDataFrame([("i", "A1", "sport")], "issue string, article_id string, category string")
    assert {(r.block_id, r.article_id, r.category) for r in markup.placed(geometry, got, themes).collect()} == {("B1", "A1", "sport"), ("B2", "A2", None)}
    weights = spark.createDataFrame([("i", "p", "B1", [0.3, 0.7]), ("i", "p", "B2", [0.1, 0.9]), ("i", "p", "B9", [0.8, 0.2])], "issue string, page string, block_id string, dist array<double>")
    cover = markup.topic_cover(weights, got, 0).collect()
    assert {(r.article_id, r.n, r.n_blocks, r.n_strong) for r in cover} == {("A1", 1, 3, 2), (None, 1, 3, 2)}


def test_years(spark):
    rows = [(f"<dc:date>{d}</dc:date><dc:date>1700</dc:date>",) for d in ("1898-05-01", "1898/05/01", "1898-05-01/1899-01-01", "1750")]
    assert [r.year for r in markup.years(spark.createDataFrame(rows, "content string")).collect()] == [1898, 1898, 1898, None]


def test_json_tables(spark, tmp_path):
    (tmp_path / "12_x.json").write_text(json.dumps({"articles": [{"article_id": "a", "title": "t", "themes": [{"code": "1", "label_fr": "p"}]}, {"article_id": "b", "title": "", "themes": []}]}))
    got = tables.attributions(spark, str(tmp_path / "*.json")).collect()
    assert [(r.fascicule, r.article_id) for r in got] == [("12", "a")] and tables.attributions(spark, str(tmp_path / "*.json"), True).count() == 2
    (tmp_path / "c.skos").write_text(json.dumps({"conceptSet": [{"uri": "u1", "qcode": "m:1", "prefLabel": {"fr": "x"}}, {"uri": "u2", "qcode": "m:2", "prefLabel": {}, "retired": "2020"}], "hasTopConcept": ["u1"]}))
    assert [(r.qcode, r.is_top) for r in tables.concepts(spark, str(tmp_path / "c.skos")).collect()] == [("m:1", True)]
    assert {(r.qcode, r.is_top, r.retired) for r in tables.concepts(spark, str(tmp_path / "c.skos"), keep_retired=True).collect()} == {("m:1", True, None), ("m:2", False, "2020")}
    text = spark.createDataFrame([(json.dumps({"i|a": {"codes": ["1"]}, "i|b": {"erreur": "x"}}),)], "content string")
    assert [tuple(r) for r in tables.regimes(text).collect()] == [("i", "a", ["1"])]


def test_line_tables(spark):
    lines = lambda *x: spark.createDataFrame([(s,) for s in x], "value string")
    assert tuple(tables.doc_topics(lines("0\td1\t0.25\t0.75", "#doc", "1\td2")).first()) == (0, "d1", [0.25, 0.75])
    assert tables.topic_keys(lines("3\t0.5\ta b c ")).first().top_words == ["a", "b", "c"]
    assert tables.word_list(lines(" Le ", "# x", "", "au lieu de"), phrases=True) == ["au lieu de", "le"]
    kit = spark.createDataFrame([("# Kit\n\n## A001\ntexte\n**oui** **non**\n## A002\nb",)], "content string")
    assert [(r.item, r.candidates) for r in tables.kit_items(kit).collect()] == [("A001", ["oui", "non"]), ("A002", [])]


def test_sinks_and_resume(spark, tmp_path):
    df = spark.createDataFrame([("i", "a", ["x", "y"]), ("j", "b", ["z"])], "fascicule string, doc_id string, tokens array<string>")
    sinks.by_issue(df, str(tmp_path / "r"))
    sinks.by_issue(df.where("doc_id = 'a'"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2
    sinks.training_text(df, str(tmp_path / "t"))
    assert {(r.doc_id, tuple(r.tokens)) for r in tables.training_text(spark.read.text(str(tmp_path / "t"))).collect()} == {("a", ("x", "y")), ("b", ("z",))}
    assert "| a |" in sinks.markdown(df.select("doc_id"), "T")
    done = spark.createDataFrame([("a", None), ("b", "timeout")], "doc_id string, error string")
    assert [r.doc_id for r in windows.pending(df, done, "doc_id").collect()] == ["b"]


def test_stream_equals_batch(spark):
    sf = "/root/testdata/sf0.001"
    stream = {tuple(r) for r in windows.run_once(spark, f"{sf}/events.parquet", "5 days").collect()}
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = e.groupBy(F.window("ts", "5 days"), "event_type").count().select(F.col("window.start").cast("timestamp_ntz"), "event_type", "count")
    assert stream == {tuple(r) for r in batch.collect()}


def test_csv_tables(spark, tmp_path):
    (tmp_path / "r.csv").write_text('﻿item,extra,reponse,secondes\nA001,x,o,1.5\nA002,y,"n, ""?""",later\n', encoding="utf-8")
    got = tables.csv_table(spark, str(tmp_path / "r.csv"), "responses")
    assert [tuple(r) for r in got.orderBy("item").collect()] == [("A001", "o", 1.5, None), ("A002", 'n, "?"', None, None)]
    sinks.csv(got, str(tmp_path / "out"), ["reponse", "item"])
    back = tables.csv_table(spark, str(tmp_path / "out"), schema="item string, reponse string")
    assert sorted(tuple(r) for r in back.collect()) == [("A001", "o"), ("A002", 'n, "?"')]


def test_runs(spark, tmp_path):
    def put(run, name, value):
        (tmp_path / run).mkdir(exist_ok=True)
        (tmp_path / run / name).write_text(json.dumps(value))

    put("b", "meta.json", {"source": "s", "k": 5, "n_docs": 50, "graine": 2, "freq_min": 5})
    put("b", "topics.json", [{"topic_id": 0, "top_words": "a b c d e mot", "size": 3}, {"topic_id": 1, "top_words": "mot", "size": 30}])
    put("b", "metrics.json", {"npmi": {"npmi_mean": 0.11115}, "diversity": {"diversity": 0.8, "tokens_distincts": 9}, "entropy": {"entropy_normalized": 0.5}})
    put("b", "metrics_brut.json", {"npmi": {"npmi_mean": 0.2}})
    put("a", "meta.json", {"source": "s", "k": 5, "n_docs": 90, "granularite": "article"})
    put("a", "metrics.json", {"npmi": {"npmi_mean": 0.3}})
    put("a", "metrics_ref.json", {"npmi": {"npmi_mean": 0.4}})
    put("c", "topics.json", [])
    put("d", "meta.json", {"source": "s", "n_docs": 1})
    got = {r.run: r for r in runs.recap(spark, str(tmp_path), 50).collect()}
    assert {k: r.pos for k, r in got.items()} == {"a": 1, "b": 2}
    b = got["b"]
    assert (b.noise_topics, b.noise_docs, b.ratio, b.npmi, b.vocabulary, b.granularite, b.longueur_min) == (1, 3, 10.0, 0.2, 9, "bloc", 2)
    assert got["a"].npmi == 0.4 and got["a"].ratio is None
    assert runs.pick(spark, str(tmp_path)) == "d" and runs.pick(spark, str(tmp_path), last=False, without="^a") == "b"
    assert topics.non_empty(runs.topics(spark, str(tmp_path))).count() == 2


def test_assignments_of_any_shape(spark):
    texts = ['[{"span_id": "a", "topic": 3}, {"doc_id": "b", "topic_id": 4}]', '{"c": 5, "d": {"topic": 6, "weight": 0.5}}']
    got = tables.read_assignments(spark.createDataFrame([(t,) for t in texts], "content string"))
    assert {tuple(r) for r in got.collect()} == {("a", 3), ("b", 4), ("c", 5), ("d", 6)}
    rows = spark.createDataFrame([("x", 1)], "id string, topic int")
    assert tuple(tables.assignments(rows).first()) == ("x", 1)


def test_manifests_issues_and_folders(spark, tmp_path):
    ids = spark.createDataFrame([("a", 0), ("b", 1)], "doc_id string, pos int")
    other = spark.createDataFrame([("a", 1), ("b", 0)], "doc_id string, pos int")
    assert tables.matching_manifest(ids, other) and not tables.matching_manifest(ids, other, order="pos")
    assert not tables.matching_manifest(ids, ids.union(ids))
    assert [r.fascicule for r in tables.issues(spark.createDataFrame([("2_reocr",), ("1",), ("2",)], "fascicule string"), first=2).collect()] == ["1", "2"]
    (tmp_path / "one").mkdir()
    paths = {"one": str(tmp_path / "one"), "two": str(tmp_path / "two")}
    assert set(tables.present(spark, paths, ["one"])) == {"one"}
    with pytest.raises(FileNotFoundError):
        tables.present(spark, paths)


def test_spreadsheet(spark):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook><sheets><sheet name="U"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>date</t></si><si><r><t>18</t></r><r><t>98</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row><c r="A2" t="s"><v>1</v></c></row></sheetData></worksheet>')
    assert tables.sheet(buf.getvalue(), "U") == [["date", None, "7"], ["1898"]]
    a, b = (spark.createDataFrame(x, "k string, y int") for x in ([("p", 1), ("q", 2), ("r", None)], [("p", 1), ("q", 3), ("r", None), ("s", 1)]))
    assert tuple(tables.agreement(a, b, "k", "y").first()) == (3, 2)


def test_sinks_of_runs_and_kits(spark, tmp_path):
    df = spark.createDataFrame([(0, "a")], "topic_id int, w string")
    sinks.run_tables(str(tmp_path / "runs"), "r1", topics=df)
    sinks.run_tables(str(tmp_path / "runs"), "r2", topics=df)
    sinks.run_tables(str(tmp_path / "runs"), "r1", topics=df)
    assert spark.read.parquet(str(tmp_path / "runs/topics")).count() == 2
    items = spark.createDataFrame([("A002", "deux", ["x"]), ("A001", "un", ["p", "q"])], "item string, text string, candidates array<string>")
    back = tables.kit_items(spark.createDataFrame([(sinks.kit(items, "Kit"),)], "content string")).collect()
    assert [(r.item, r.candidates) for r in back] == [("A001", ["p", "q"]), ("A002", ["x"])]
    assert sinks.two_columns([("a", 5), ("b", 3), ("c", 3)]) == (["a"], ["b", "c"])
    with pytest.raises(ValueError):
        sinks.markdown(spark.range(3), "T", most=2)
    with pytest.raises(ValueError):
        tables.word_list(spark.createDataFrame([("a",), ("b",)], "value string"), most=1)


def test_checkpointed_work_goes_on(spark, tmp_path):
    items = spark.createDataFrame([(i,) for i in range(20)], "id long")
    path = str(tmp_path / "done")
    seen = []

    def work(df):
        seen.append(df.count())
        return df.select("id", F.when(F.col("id") == 7, F.lit("timeout")).alias("error"))

    assert sinks.checkpointed(items, path, "id", work, rows=5) == 4 and sum(seen) == 20
    assert sinks.checkpointed(items, path, "id", work, rows=5) == 1 and seen[-1] == 1
    latest = windows.latest(spark.read.parquet(path), "id", "error")
    assert latest.count() == 20


def test_resume_of_a_stream(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "id long").write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    spark.createDataFrame([(1, None)], "id long, error string").write.parquet(out)
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    done = lambda df: df.select("id", F.lit(None).cast("string").alias("error"))
    q = windows.resume_into(stream, "id", lambda: spark.read.parquet(out), lambda df: df.write.mode("append").parquet(out), done, str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2]

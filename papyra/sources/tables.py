"""Readers of the text and JSON tables around a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THEMES = "array<struct<code:string,label_fr:string>>"
ISSUE = f"fascicule string, usage map<string,string>, articles array<struct<article_id:string,title:string,themes:{THEMES}>>"
CONCEPTS = "conceptSet array<struct<uri:string,qcode:string,prefLabel:map<string,string>,broader:array<string>,retired:string>>, hasTopConcept array<string>"


def concepts(spark: SparkSession, path: str, keep_retired: bool = False) -> DataFrame:
    """(uri, qcode, pref_label, broader, retired, is_top) of a concept scheme."""
    raw = spark.read.schema(CONCEPTS).json(path, multiLine=True)
    out = raw.select(F.explode("conceptSet").alias("c"), F.coalesce("hasTopConcept", F.array().cast("array<string>")).alias("top"))
    out = out.select("c.uri", "c.qcode", F.col("c.prefLabel").alias("pref_label"), "c.broader", "c.retired", F.coalesce(F.array_contains("top", F.col("c.uri")), F.lit(False)).alias("is_top"))
    return out if keep_retired else out.where("retired IS NULL")


def attributions(spark: SparkSession, path: str, keep_empty: bool = False) -> DataFrame:
    """(fascicule, article_id, title, themes): the issue falls back to its file's name before ``_``."""
    raw = spark.read.schema(ISSUE).json(path, multiLine=True)
    stem = F.regexp_extract("_metadata.file_name", r"^([^_.]+)", 1)
    rows = raw.select(F.coalesce("fascicule", stem).alias("fascicule"), F.explode("articles").alias("a")).select("fascicule", "a.*")
    return rows if keep_empty else rows.where(F.size("themes") > 0)


def regimes(files: DataFrame, content: str = "content") -> DataFrame:
    """(fascicule, article_id, codes) of ``{"issue|article": {"codes": [...]}}``; failed entries have none and go."""
    entry = F.explode(F.from_json(content, "map<string,struct<codes:array<string>,erreur:string>>"))
    rows = files.select(entry).where("value.codes IS NOT NULL")
    key = F.split("key", r"\|", 2)
    return rows.select(key[0].alias("fascicule"), key[1].alias("article_id"), F.col("value.codes").alias("codes"))


def doc_topics(lines: DataFrame, value: str = "value") -> DataFrame:
    """(pos, doc_id, dist) of tab-separated topic shares; lines of under three fields go."""
    p = F.split(value, "\t")
    dist = F.transform(F.filter(F.slice(p, 3, F.size(p)), lambda x: x != ""), lambda x: x.cast("double"))
    return lines.where(~F.startswith(F.col(value), F.lit("#")) & (F.size(p) >= 3)).select(p[0].cast("int").alias("pos"), p[1].alias("doc_id"), dist.alias("dist"))


def topic_keys(lines: DataFrame, n: int = 10, value: str = "value") -> DataFrame:
    p = F.split(value, "\t")
    return lines.where(F.size(p) >= 3).select(p[0].cast("int").alias("topic_id"), F.slice(F.split(F.trim(p[2]), " "), 1, n).alias("top_words"))


def training_text(lines: DataFrame, value: str = "value") -> DataFrame:
    p = F.split(value, "\t", 3)
    return lines.where(F.size(p) == 3).select(p[0].alias("doc_id"), F.filter(F.split(p[2], " "), lambda w: w != "").alias("tokens"))


def assignments(rows: DataFrame) -> DataFrame:
    """(doc_id, topic_id) whatever the keys are called: doc_id, span_id or id; topic_id or topic."""
    pick = lambda *names: F.coalesce(*(F.col(n) for n in names if n in rows.columns))
    return rows.select(pick("doc_id", "span_id", "id").cast("string").alias("doc_id"), pick("topic_id", "topic").cast("int").alias("topic_id"))


#: Keys by which an assignment file may call its document and its topic.
DOC_KEYS, TOPIC_KEYS = ("doc_id", "span_id", "id"), ("topic_id", "topic")


def read_assignments(files: DataFrame, content: str = "content") -> DataFrame:
    """``assignments`` of JSON files that hold a list of objects, or an object of topics (or of objects) by document."""
    c = F.trim(content)
    first = lambda m, keys: F.coalesce(*(F.try_element_at(m, F.lit(k)) for k in keys))
    listed = files.where(F.startswith(c, F.lit("["))).select(F.explode(F.from_json(content, "array<map<string,string>>")).alias("m"))
    out = listed.select(first(F.col("m"), DOC_KEYS).alias("doc_id"), first(F.col("m"), TOPIC_KEYS).cast("int").alias("topic_id"))
    keyed = files.where(F.startswith(c, F.lit("{"))).select(F.explode(F.from_json(content, "map<string,string>")).alias("doc_id", "v"))
    own = first(F.from_json("v", "map<string,string>"), TOPIC_KEYS)
    return out.union(keyed.select("doc_id", F.coalesce(own, F.col("v")).try_cast("int")))


def word_list(lines: DataFrame, value: str = "value", phrases: bool = False, most: int = 1_000_000) -> list[str]:
    """A stop list: lower-case, without blanks and comments; phrases longest first. More than ``most`` words are an error."""
    w = F.lower(F.trim(value))
    words = lines.select(w.alias("w")).where((F.col("w") != "") & ~F.startswith(F.col("w"), F.lit("#"))).distinct()
    out = sorted(r.w for r in words.limit(most + 1).collect())
    if len(out) > most:
        raise ValueError(f"a word list of more than {most} words")
    return sorted(out, key=len, reverse=True) if phrases else out


def kit_items(files: DataFrame, content: str = "content") -> DataFrame:
    """(item, body, candidates) of a Markdown kit, one second-level heading per item."""
    part = F.explode(F.slice(F.split(content, r"\n## "), 2, 1_000_000)).alias("p")
    return files.select(part).select(F.regexp_extract("p", r"^\s*(\S+)", 1).alias("item"), F.regexp_extract("p", r"(?s)^[^\n]*\n(.*)$", 1).alias("body"), F.regexp_extract_all("p", F.lit(r"\*\*([^*]+)\*\*"), F.lit(1)).alias("candidates"))


def matching_manifest(vectors: DataFrame, ids: DataFrame, key: str = "doc_id", order: str | None = None) -> bool:
    """A cache of embeddings holds exactly the wanted ids, and in the same order, if a column ``order`` says it."""
    both = [vectors, ids]
    columns = [key, order] if order else [key]
    a, b = (x.select(*columns) for x in both)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


# Columns of the tables that cost and trial runs exchange.
CSV = {
    "articles": "fascicule string, article_id string, tokens long, words long, total_nc double, total_c double",
    "lots": "fascicule string, lot long, n long, tokens long, cost_nc double, cost_c double",
    "baselines": "fascicule string, n long, cost_nc double, cost_c double",
    "responses": "item string, reponse string, secondes double, horodatage string",
}


def csv_table(spark: SparkSession, path: str, kind: str | None = None, schema: str | None = None, separator: str = ",") -> DataFrame:
    """A table with a header, by a schema of CSV or one's own: columns are found by name, missing ones are null, others dropped.

    A value that isn't of its type is null. No pass over the data infers anything.
    """
    wanted = schema or CSV[kind]
    raw = spark.read.csv(path, header=True, sep=separator, quote='"', escape='"', multiLine=True, encoding="UTF-8")
    there = {c.strip("\ufeff ").lower(): c for c in raw.columns}
    fields = [f.strip().rsplit(" ", 1) for f in wanted.split(",")]
    of = lambda n: F.col(f"`{there[n.lower()]}`") if n.lower() in there else F.lit(None)
    return raw.select(*(of(n).try_cast(t).alias(n) for n, t in fields))


def sheet(content: bytes, name: str | None = None) -> list[list[str | None]]:
    """Rows of a sheet of a spreadsheet file (zipped markup), as text; of the first one if none is named."""
    import io
    import re
    import xml.etree.ElementTree as ET
    import zipfile

    local = lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        strings = []
        if "xl/sharedStrings.xml" in z.namelist():
            root = ET.fromstring(z.read("xl/sharedStrings.xml"))
            strings = ["".join(t.text or "" for t in si.iter() if local(t) == "t") for si in root if local(si) == "si"]
        sheets = [e.get("name") for e in ET.fromstring(z.read("xl/workbook.xml")).iter() if local(e) == "sheet"]
        at = sheets.index(name) + 1 if name else 1
        rows = []
        for row in (e for e in ET.fromstring(z.read(f"xl/worksheets/sheet{at}.xml")).iter() if local(e) == "row"):
            cells = {}
            for c in (e for e in row if local(e) == "c"):
                letters = re.match("[A-Z]*", c.get("r", "")).group()
                place = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1 if letters else len(cells)
                value = "".join(t.text or "" for t in c.iter() if local(t) in ("v", "t"))
                cells[place] = strings[int(value)] if c.get("t") == "s" else value or None
            rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return rows


def agreement(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(common, agree): keys that both tables have, and those with the same value: the cross-check of two sources."""
    met = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key)
    return met.agg(F.count("*").alias("common"), F.count_if(F.col("x").eqNullSafe(F.col("y"))).alias("agree"))


def issues(rows: DataFrame, name: str | Column = "fascicule", first: int | None = None) -> DataFrame:
    """Issues in order, without the suffix of re-read ones."""
    c = F.regexp_replace(F.col(name) if isinstance(name, str) else name, "_reocr$", "")
    out = rows.select(c.alias("fascicule")).distinct().orderBy("fascicule")
    return out.limit(first) if first else out


def one_run(paths: DataFrame, last: bool = True, without: str | None = None, path: str = "path") -> DataFrame:
    """The first or last path by name of those that a pattern doesn't exclude."""
    some = paths.where(~F.col(path).rlike(without)) if without else paths
    return some.agg((F.max if last else F.min)(path).alias(path)).where(F.col(path).isNotNull())


def present(spark: SparkSession, paths: dict[str, str], required: list[str] | None = None) -> dict[str, str]:
    """Source folders that exist; missing required ones (all, if None) are an error."""
    def there(p: str) -> bool:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    found = {k: p for k, p in paths.items() if there(p)}
    missing = [k for k in (paths if required is None else required) if k not in found]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    return found

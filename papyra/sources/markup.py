"""Page and table-of-contents markup: ALTO and METS, any version and name space.

One reader serves both: a file becomes an array of its wanted elements in document
order, each with the places of its ancestors and of its last descendant. What an
article or a block is, is then said in column expressions over that array, file by
file, without a shuffle. A malformed file has an ``error`` and no elements.
"""

from __future__ import annotations

import io
import xml.sax
from collections.abc import Iterator
from xml.sax.saxutils import XMLGenerator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions import text as X

# Tags of title blocks, and the least side of a block worth cropping.
TITLE_LABELS = ("title", "subtitle", "heading")
MIN_SIDE = 20
# The elements that the two formats are read for.
ALTO_NAMES = ("StructureTag", "TextBlock", "TextLine", "String")
METS_NAMES = ("file", "FLocat", "dmdSec", "title", "structMap", "div", "area")

_ELEMENT = pa.struct([("name", pa.string()), ("path", pa.list_(pa.int32())), ("last", pa.int32()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())])
ELEMENTS = "array<struct<name:string,path:array<int>,last:int,attrs:map<string,string>,text:string>>"


class _Collector(xml.sax.ContentHandler):
    """Wanted elements by local name, as they end."""

    def __init__(self, names: tuple[str, ...]):
        super().__init__()
        self.names, self.found, self.open, self.wanted = set(names), [], [], []

    def startElement(self, name, attrs):  # noqa: N802
        local = name.rpartition(":")[2]
        at = None
        if local in self.names:
            at = len(self.found)
            own = {k.rpartition(":")[2]: v for k, v in attrs.items()}
            self.found.append({"name": local, "path": list(self.wanted), "last": at, "attrs": list(own.items()), "text": ""})
            self.wanted.append(at)
        self.open.append(at)

    def characters(self, content):
        if self.open and self.open[-1] is not None:
            self.found[self.open[-1]]["text"] += content

    def endElement(self, name):  # noqa: N802
        if self.open.pop() is not None:
            self.found[self.wanted.pop()]["last"] = len(self.found) - 1


def _collect(content: str | None, names: tuple[str, ...]) -> tuple[list[dict] | None, str | None]:
    handler = _Collector(names)
    try:
        xml.sax.parseString((content or "").encode(), handler)
    except xml.sax.SAXException as e:
        return None, str(e)
    return handler.found, None


def elements(files: DataFrame, keep: list[str], names: tuple[str, ...], content: str = "content") -> DataFrame:
    """(keep, e, error): the elements of each file."""
    kinds = {f.name: f.dataType.simpleString() for f in files.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a file at a time: its elements are many times its row
                row = batch.slice(i, 1)
                found, error = _collect(row.column(content)[0].as_py(), names)
                yield pa.record_batch([*(row.column(c) for c in keep), pa.array([found], pa.list_(_ELEMENT)), pa.array([error], pa.string())], names=[*keep, "e", "error"])

    return files.select(*keep, content).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"e {ELEMENTS}", "error string"]))


def attr(x: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(x["attrs"], F.lit(name)), F.lit(""))


def _whole(c: Column) -> Column:
    """A number as an integer, 0 if it is none."""
    return F.coalesce(c.try_cast("double").cast("int"), F.lit(0))


def _places(test) -> Column:
    """Places of the elements that pass."""
    return F.filter(F.sequence(F.lit(0), F.size("e") - 1), lambda i: (F.size("e") > 0) & test(F.get("e", i)))


def _below(i: Column | str, name: str) -> Column:
    """Descendants of one name of the element at a place."""
    i = F.col(i) if isinstance(i, str) else i
    return F.filter(F.slice("e", i + 2, F.get("e", i)["last"] - i), lambda x: x["name"] == name)


def _last(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def _filled(values: Column, by: str) -> Column:
    return F.array_join(F.filter(values, lambda s: s != ""), by)


def blocks(files: DataFrame, keep: list[str], content: str = "content", min_side: int = 0) -> DataFrame:
    """Blocks of ALTO files in order: (keep, block_id, pos, text, lines, is_title, x, y, w, h, error).

    ``text`` has hyphenated halves rejoined, in one line; ``lines`` are as printed. With
    ``min_side`` (MIN_SIDE for crops), too small ones go.
    """
    e = elements(files, keep, ALTO_NAMES, content)
    at = e.select("*", F.posexplode(_places(lambda x: x["name"] == "TextBlock")).alias("pos", "b"))
    me = F.get("e", F.col("b"))
    # the first reference that names a tag decides
    tags = F.filter("e", lambda x: x["name"] == "StructureTag")
    label = lambda ref: F.lower(attr(_last(F.filter(tags, lambda x: attr(x, "ID") == ref)), "LABEL"))
    known = F.filter(F.split(attr(me, "TAGREFS"), r"\s+"), lambda r: F.exists(tags, lambda x: attr(x, "ID") == r))
    # lines are elements too: their places are found among the block's
    rows = F.filter(F.sequence(F.col("b"), me["last"]), lambda i: F.get("e", i)["name"] == "TextLine")
    strings = F.transform(rows, lambda i: _below(i, "String"))
    printed = F.transform(strings, lambda line: _filled(F.transform(line, lambda s: attr(s, "CONTENT")), " "))
    whole = lambda s: F.when(attr(s, "SUBS_TYPE") == "HypPart1", attr(s, "SUBS_CONTENT")).otherwise(attr(s, "CONTENT"))
    joined = F.transform(strings, lambda line: _filled(F.transform(F.filter(line, lambda s: attr(s, "SUBS_TYPE") != "HypPart2"), whole), " "))
    box = [_whole(attr(me, n)).alias(k) for k, n in zip("xywh", ("HPOS", "VPOS", "WIDTH", "HEIGHT"))]
    title = F.coalesce(label(F.get(known, F.lit(0))).isin(*TITLE_LABELS), F.lit(False))
    out = at.select(*keep, attr(me, "ID").alias("block_id"), "pos", F.trim(_filled(joined, " ")).alias("text"), _filled(printed, "\n").alias("lines"), title.alias("is_title"), *box, F.lit(None).cast("string").alias("error"))
    if min_side:
        out = out.where((F.col("w") >= min_side) & (F.col("h") >= min_side))
    return out.unionByName(e.where("error IS NOT NULL").select(*keep, "error"), allowMissingColumns=True)


def tokens(files: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    """Lower-case tokens of all but title blocks."""
    words = F.filter(F.split(F.lower("lines"), r"\s+"), lambda w: w != "")
    return blocks(files, keep, content).where("error IS NULL AND NOT is_title").select(*keep, F.explode(words).alias("token"))


def page_texts(files: DataFrame, issue: str, page: str, content: str = "content") -> DataFrame:
    """(issue, pages): the text of each page without its title blocks, as a map by page."""
    some = blocks(files, [issue, page], content).where("error IS NULL AND NOT is_title AND lines <> ''")
    text = some.groupBy(issue, page).agg(F.sort_array(F.collect_list(F.struct("pos", "lines"))).alias("l"))
    text = text.select(issue, F.struct(page, F.array_join(F.transform("l", lambda x: x["lines"]), "\n")).alias("p"))
    return text.groupBy(issue).agg(F.map_from_entries(F.sort_array(F.collect_list("p"))).alias("pages"))


def toc(files: DataFrame, keep: list[str], content: str = "content", first_map: bool = False, known_files: bool = True) -> DataFrame:
    """Areas of the ARTICLE divisions of METS files' logical maps, in order:
    (keep, article_id, title, toc_pos, map, pos, page, file_id, block_id, error).

    Of the first logical map only, and of listed files only, if asked. A title is the
    division's label, its description's first title, or its id.
    """
    e = elements(files, keep, METS_NAMES, content)
    logical = _places(lambda x: (x["name"] == "structMap") & (F.lower(attr(x, "TYPE")) == "logical"))
    article = lambda x: (x["name"] == "div") & (F.upper(attr(x, "TYPE")) == "ARTICLE") & F.arrays_overlap(x["path"], F.col("logical"))
    parent = lambda x, name: F.get("e", _last(F.filter(x["path"], lambda p: F.get("e", p)["name"] == name)))
    listed = F.transform(F.filter("e", lambda x: x["name"] == "FLocat"), lambda x: F.struct(attr(parent(x, "file"), "ID").alias("id"), F.regexp_replace(attr(x, "href"), "^.*/", "").alias("page")))
    maps = e.select("*", logical.alias("logical")).withColumn("listed", listed)
    at = maps.select("*", F.posexplode(_places(article)).alias("toc_pos", "a"))
    me = F.get("e", F.col("a"))
    described = _places(lambda x: (x["name"] == "dmdSec") & (attr(x, "ID") == attr(me, "DMDID")))
    titles = F.filter(F.transform(F.flatten(F.transform(described, lambda d: _below(d, "title"))), lambda x: F.trim(x["text"])), lambda s: s != "")
    title = F.coalesce(F.nullif(attr(me, "LABEL"), F.lit("")), F.get(titles, F.lit(0)), attr(me, "ID"))
    number = F.array_position("logical", _last(F.array_intersect(me["path"], F.col("logical")))) - 1
    areas = F.filter(_below("a", "area"), lambda x: attr(x, "BEGIN") != "")
    rows = at.select(*keep, attr(me, "ID").alias("article_id"), title.alias("title"), "toc_pos", number.cast("int").alias("map"), "listed", F.posexplode(areas).alias("pos", "area"))
    area = F.col("area")
    page = F.nullif(_last(F.filter("listed", lambda x: x["id"] == attr(area, "FILEID")))["page"], F.lit(""))
    out = rows.select(*keep, "article_id", "title", "toc_pos", "map", "pos", page.alias("page"), attr(area, "FILEID").alias("file_id"), attr(area, "BEGIN").alias("block_id"), F.lit(None).cast("string").alias("error"))
    if first_map:
        out = out.where("map = 0")
    if known_files:
        out = out.where("page IS NOT NULL")
    return out.unionByName(e.where("error IS NOT NULL").select(*keep, "error"), allowMissingColumns=True)


def scanned_toc(files: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    """(keep, block_id, article_id, title) by pattern, for files that needn't be well formed.

    An article has all blocks named up to the next article; a block named by several is
    the last one's.
    """
    opens = r'<div ID="([^"]+)" [^>]*TYPE="ARTICLE"[^>]*LABEL="([^"]*)"'
    part = files.select(*keep, F.posexplode(F.split(content, f"(?={opens})")).alias("n", "part"))
    own = part.where(F.col("part").rlike(f"^{opens}")).select(*keep, "n", F.regexp_extract("part", opens, 1).alias("article_id"), F.regexp_extract("part", opens, 2).alias("title"), F.explode(F.regexp_extract_all("part", F.lit('BEGIN="([A-Z0-9_]+)"'), F.lit(1))).alias("block_id"))
    return own.groupBy(*keep, "block_id").agg(F.max_by(F.struct("article_id", "title"), "n").alias("a")).select(*keep, "block_id", "a.*")


def articles(areas: DataFrame, page_blocks: DataFrame, issue: str, kind: str = "lines") -> DataFrame:
    """(issue, article_id, title, text, pages): blocks in reading order.

    ``lines``: as printed, blocks apart by a blank line; ``text``: hyphens
    rejoined, everything apart by one space. A block may serve two articles; a
    missing one adds nothing but its page; articles without text go.
    """
    at = page_blocks.where("error IS NULL").select(issue, "page", "block_id", F.col(kind).alias("_t"))
    rows = areas.where("error IS NULL").join(at, [issue, "page", "block_id"], "left")
    parts = F.sort_array(F.collect_list(F.when(F.coalesce("_t", F.lit("")) != "", F.struct("pos", "_t"))))
    out = rows.groupBy(issue, "article_id", "toc_pos").agg(F.first("title").alias("title"), F.array_join(F.transform(parts, lambda p: p["_t"]), "\n\n" if kind == "lines" else " ").alias("text"), F.sort_array(F.collect_set("page")).alias("pages"))
    return out.where(F.trim("text") != "")


def articles_per_page(areas: DataFrame, issue: str) -> DataFrame:
    return areas.where("error IS NULL").select(issue, "page", "article_id").distinct().groupBy(issue, "page").agg(F.count("*").alias("n_articles"))


def placed(page_blocks: DataFrame, owners: DataFrame, categories: DataFrame, issue: str = "issue") -> DataFrame:
    """Blocks with their article and its category; those of no article, or of one without a category, stay with nulls."""
    at = page_blocks.where("error IS NULL").join(owners, [issue, "block_id"], "left")
    return at.join(categories.select(issue, "article_id", "category"), [issue, "article_id"], "left")


def topic_cover(weights: DataFrame, owners: DataFrame, topic: int, least: float = 0.30, issue: str = "issue") -> DataFrame:
    """(issue, page, article_id, title, n, n_blocks, n_strong): a page's blocks that a topic fills, by article.

    ``weights``: (issue, page, block_id, dist). A block of no article counts under nulls.
    """
    strong = F.get("dist", F.lit(topic)) >= least
    per = weights.groupBy(issue, "page").agg(F.count("*").alias("n_blocks"), F.count_if(strong).alias("n_strong"))
    found = weights.where(strong).join(owners, [issue, "block_id"], "left").groupBy(issue, "page", "article_id", "title").agg(F.count("*").alias("n"))
    return found.join(per, [issue, "page"])


def word_boxes(page_blocks: DataFrame, texts: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, block_id, line, word, content, x, y, w, h) of new block texts: lines share the block's height, words the line's width."""
    new = page_blocks.where("error IS NULL").drop("text", "lines").join(texts.where(F.trim("text") != ""), [*keep, "block_id"])
    lines = F.filter(F.split("text", "\n"), lambda s: F.trim(s) != "")
    rows = new.withColumn("high", F.greatest(F.lit(1), F.floor(F.col("h") / F.size(lines)))).select(*keep, "block_id", "x", "y", "w", "high", F.posexplode(lines).alias("line", "s"))
    words = rows.withColumn("ws", X.words("s")).withColumn("wide", F.greatest(F.lit(1), F.floor(F.col("w") / F.size("ws"))))
    each = words.select("*", F.posexplode("ws").alias("word", "content"))
    return each.select(*keep, "block_id", "line", "word", "content", (F.col("x") + F.col("word") * F.col("wide")).cast("int").alias("x"), (F.col("y") + F.col("line") * F.col("high")).cast("int").alias("y"), F.col("wide").cast("int").alias("w"), F.col("high").cast("int").alias("h"), F.col("w").alias("line_w"), F.col("x").alias("line_x"))


class _Writer(XMLGenerator):
    """Copies a file; blocks with new words get these for content."""

    def __init__(self, out, boxes: dict[str, list[dict]]):
        super().__init__(out, "utf-8", short_empty_elements=True)
        self.boxes, self.depth, self.skip = boxes, 0, None

    def startElement(self, name, attrs):  # noqa: N802
        self.depth += 1
        if self.skip is not None:
            return
        super().startElement(name, attrs)
        prefix, colon, local = name.rpartition(":")
        new = self.boxes.get(attrs.get("ID", "")) if local == "TextBlock" else None
        if new:
            self.skip = self.depth
            self._lines(prefix + colon, attrs["ID"], new)

    def _lines(self, prefix: str, block: str, boxes: list[dict]) -> None:
        line = None
        for b in sorted(boxes, key=lambda b: (b["line"], b["word"])):
            place = {"VPOS": str(b["y"]), "HEIGHT": str(b["h"])}
            if b["line"] != line:
                if line is not None:
                    super().endElement(prefix + "TextLine")
                line = b["line"]
                super().startElement(prefix + "TextLine", {"ID": f"{block}_L{line}", "HPOS": str(b["line_x"]), "VPOS": place["VPOS"], "WIDTH": str(b["line_w"]), "HEIGHT": place["HEIGHT"]})
            else:
                super().startElement(prefix + "SP", {})
                super().endElement(prefix + "SP")
            own = {"ID": f"{block}_L{line}_S{b['word']}", "HPOS": str(b["x"]), "VPOS": place["VPOS"], "WIDTH": str(b["w"]), "HEIGHT": place["HEIGHT"], "CONTENT": b["content"]}
            super().startElement(prefix + "String", own)
            super().endElement(prefix + "String")
        super().endElement(prefix + "TextLine")

    def endElement(self, name):  # noqa: N802
        if self.skip == self.depth:
            self.skip = None
        if self.skip is None:
            super().endElement(name)
        self.depth -= 1

    def characters(self, content):
        if self.skip is None:
            super().characters(content)


def rewritten(files: DataFrame, texts: DataFrame, keep: list[str], content: str = "content") -> DataFrame:
    """(keep, content): ALTO files with the texts (keep, block_id, text) in place of their blocks' own; blank ones change nothing."""
    boxes = word_boxes(blocks(files, keep, content), texts, keep)
    per = boxes.groupBy(*keep).agg(F.collect_list(F.struct("block_id", "line", "word", "content", "x", "y", "w", "h", "line_x", "line_w")).alias("boxes"))
    kinds = {f.name: f.dataType.simpleString() for f in files.schema}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = []
            for source, new in zip(pdf[content], pdf["boxes"]):
                of: dict[str, list[dict]] = {}
                for b in () if new is None else new:
                    of.setdefault(b["block_id"], []).append(b)
                out = io.StringIO()
                if of:
                    xml.sax.parseString(source.encode(), _Writer(out, of))
                done.append(out.getvalue() if of else source)
            yield pdf[keep].assign(**{content: done})

    return files.select(*keep, content).join(per, keep, "left").mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in [*keep, content]))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def years(manifests: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``year``: of the first date, in any of its spellings."""
    return manifests.withColumn("year", X.year_of(F.regexp_extract(content, r"<dc:date[^>]*>\s*([^<]+)", 1)))

"""Requests to a chat model for labels, and what its answers are worth.

A request is plain data (a dictionary that any client can send). Answers are bound to
a strict JSON schema; ``answers`` checks them as columns, so nothing invalid gets on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions import text as X

MIN_THEMES, MAX_THEMES = 1, 5


def _object(**properties) -> dict:
    """An object with all of its properties and no others, in this order: the order in which a model writes them."""
    return {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}


def themes_schema(codes: Sequence[str], least: int = MIN_THEMES, most: int = MAX_THEMES) -> dict:
    return {"type": "array", "items": {"type": "string", "enum": list(codes)}, "minItems": least, "maxItems": most}


def single(codes: Sequence[str], justified: bool = False, most: int = MAX_THEMES) -> dict:
    """The answer about one article; ``justified`` asks for a sentence before the labels, so that it leads to them."""
    first = {"justification": {"type": "string"}} if justified else {}
    return _object(**first, themes=themes_schema(codes, most=most))


def batched(codes: Sequence[str], ids: Sequence[str]) -> dict:
    """The answer about a lot: exactly one entry an article, of the lot's own ids."""
    entry = _object(article_id={"type": "string", "enum": list(ids)}, themes=themes_schema(codes))
    return _object(articles={"type": "array", "items": entry, "minItems": len(ids), "maxItems": len(ids)})


def strict(schema: dict, name: str) -> dict:
    return {"type": "json_schema", "json_schema": {"name": name, "schema": schema, "strict": True}}


def prefix_key(*fixed: str) -> str:
    """A cache key: equal for requests whose fixed part is equal."""
    return hashlib.sha256("\0".join(fixed).encode()).hexdigest()[:32]


def request(model: str, system: str, fixed: str, article: str, schema: dict, cached: bool = False, name: str = "labels") -> dict:
    """One call. What all calls share stands first; with ``cached`` the service is told so."""
    messages = [{"role": "system", "content": system}, {"role": "user", "content": f"{fixed}\n\n{article}"}]
    out = {"model": model, "messages": messages, "temperature": 0.0, "response_format": strict(schema, name)}
    return out | {"prompt_cache_key": prefix_key(model, system, fixed)} if cached else out


def label_lines(labels: DataFrame, code: str = "code", label: str = "label", parent: str = "parent_label") -> DataFrame:
    """(code, line): ``code : label``, with the parent in brackets where several codes have that label."""
    twice = labels.groupBy(label).agg((F.count("*") > 1).alias("_twice"))
    context = F.when(F.col("_twice") & (F.coalesce(parent, F.lit("")) != ""), F.concat(F.lit(" ("), parent, F.lit(")"))).otherwise("")
    return labels.join(twice, label).select(code, F.concat(code, F.lit(" : "), label, context).alias("line"))


def led_in(text: str | Column, budget: int) -> Column:
    """The words of a text that ``truncated`` keeps for a first stage; 0 keeps all."""
    return F.array_join(F.slice(X.words(text), F.lit(1), X.truncated(text, budget).cast("int")), " ")


ANSWER = "struct<justification:string,themes:array<string>,articles:array<struct<article_id:string,themes:array<string>>>>"


def answers(replies: DataFrame, reply: str, codes: Sequence[str], ids: str | None = None, least: int = MIN_THEMES, most: int = MAX_THEMES) -> DataFrame:
    """Adds ``entries`` (article_id, themes), ``justification`` and ``problem`` to raw replies.

    ``ids`` names the column with a lot's ids; without it a reply is about one article. A
    problem is null, or: not JSON, a missing or foreign article, too few or many themes,
    an unknown theme. Entries hold what is usable all the same: own articles, known themes
    without repeats, up to ``most`` of them.
    """
    known = F.array(*(F.lit(c) for c in codes)) if codes else F.array().cast("array<string>")
    a = F.from_json(F.col(reply), ANSWER)
    one = F.array(F.struct(F.lit(None).cast("string").alias("article_id"), a["themes"].alias("themes")))
    raw = F.coalesce(F.filter(a["articles"] if ids else F.when(a["themes"].isNotNull(), one), lambda x: x["themes"].isNotNull()), F.array().cast("array<struct<article_id:string,themes:array<string>>>"))
    own = F.filter(raw, lambda x: F.array_contains(ids, x["article_id"])) if ids else raw
    themes = lambda x: F.slice(F.array_intersect(F.array_distinct(x["themes"]), known), 1, most)
    entries = F.filter(F.transform(own, lambda x: F.struct(x["article_id"].alias("article_id"), themes(x).alias("themes"))), lambda x: F.size(x["themes"]) >= least)
    wanted = F.array_sort(ids) if ids else None
    told = F.array_sort(F.transform(raw, lambda x: x["article_id"]))
    problem = F.when(F.size(raw) == 0, "not JSON")
    if ids:
        problem = problem.when(told != wanted, "articles")
    problem = problem.when(F.exists(raw, lambda x: ~F.size(x["themes"]).between(least, most)), "number of themes")
    problem = problem.when(F.exists(raw, lambda x: F.size(F.array_except(x["themes"], known)) > 0), "unknown theme")
    return replies.withColumns({"entries": entries, "justification": a["justification"], "problem": problem})


def require_known(rows: DataFrame, names: DataFrame, label: str = "label") -> DataFrame:
    """``rows``, if every label is one of ``names``; else an error that says which are not."""
    strange = rows.select(label).distinct().join(names.select(label), label, "left_anti").orderBy(label).limit(21).collect()
    if strange:
        more = ", ..." if len(strange) > 20 else ""
        raise ValueError("unknown labels: " + ", ".join(str(r[0]) for r in strange[:20]) + more)
    return rows

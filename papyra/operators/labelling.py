"""Classification by a pluggable model client: single, batched, and in two stages.

A client is a function of a list of (key, text) and the candidate labels that
returns {key: [labels]}; it may raise. Nothing here speaks to a network.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra import store
from papyra.functions import text as X

from . import batching, requests

Client = Callable[[list[tuple], list[str]], dict]
MAX_THEMES = 5


class Refused(Exception):
    """A client's failure, with the service's status (None: network) and how long it asks to wait."""

    def __init__(self, status: int | None = None, after: float | None = None):
        super().__init__(f"status {status}")
        self.status, self.after = status, after


def patient(client: Client, tries: int = 5, sleep: Callable[[float], None] = time.sleep) -> Client:
    """401 and 403 end the run, 400 is not tried again; 429 and 5xx wait as asked or 2, 4, ... up to 30 s; network errors 2, 4, 6 ... s."""

    def call(items, labels):
        for n in range(tries):
            try:
                return client(items, labels)
            except Refused as e:
                if e.status in (400, 401, 403) or n == tries - 1:
                    raise
                sleep(2.0 * (n + 1) if e.status is None else e.after if e.after is not None else min(30.0, 2.0 ** (n + 1)))
        return {}

    return call


def by_halves(client: Client, items: list[tuple], labels: list[str]) -> dict:
    """A lot that fails is halved until the failing items are alone; those get None."""
    try:
        return client(items, labels)
    except Refused as e:
        if e.status in (401, 403):
            raise
        if len(items) == 1:
            return {items[0][0]: None}
        mid = len(items) // 2
        return by_halves(client, items[:mid], labels) | by_halves(client, items[mid:], labels)


def valid(themes: list[str] | None, labels: set[str]) -> list[str]:
    return [x for x in dict.fromkeys(themes or []) if x in labels][:MAX_THEMES]


def keyword_client(words: dict[str, str]) -> Client:
    """A deterministic stand-in: a label for each keyword in the text."""

    def call(items, labels):
        return {k: [lab for w, lab in words.items() if w in (text or "").split() and lab in labels] for k, text in items}

    return call


def classify(articles: DataFrame, client: Client, labels: list[str], group: str, key: str, text: str = "text", tokens: str = "tok", fixed: int = 0, batched: bool = True) -> DataFrame:
    """(group, key, themes, error): articles packed into lots, one call per lot.

    A group's articles stream in order through one worker, which packs them as they come
    and holds one lot and one batch.
    """
    names, most = set(labels), batching.MAX_ITEMS if batched else 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(rows):
            got = by_halves(client, [(k, t) for _, k, t in rows], labels)
            return [(g, k, valid(got.get(k), names), "failed" if got.get(k) is None else None) for g, k, _ in rows]

        frame = lambda out: pd.DataFrame(out, columns=[group, key, "themes", "error"])
        lots, now, held = batching.Lots(fixed, most=most), None, []
        for pdf in batches:
            out: list[tuple] = []
            for g, k, t, n in pdf[[group, key, text, tokens]].itertuples(index=False, name=None):
                lot = lots(g, n)
                if held and (lots.group, lot) != now:
                    out += done(held)
                    held = []
                now = (lots.group, lot)
                held.append((g, k, t))
            yield frame(out)
        if held:
            yield frame(done(held))

    kind = {f.name: f.dataType.simpleString() for f in articles.schema}
    rows = articles.select(group, key, text, tokens).repartition(group).sortWithinPartitions(group, key)
    return rows.mapInPandas(run, f"{group} {kind[group]}, {key} {kind[key]}, themes array<string>, error string")


def cascade(articles: DataFrame, first: Client, second: Client, branches: dict[str, list[str]], group: str, key: str, text: str = "text", tokens: str = "tok", fixed: int = 0, lead_in: int = 0, batched: bool = True) -> DataFrame:
    """(key, branch, themes), in two stages: a branch for each article, then a leaf of that branch; a branch without leaves is final.

    With ``lead_in`` the first stage reads that many tokens of a text only. Between the
    stages articles are dealt by branch, whatever group they come from, so the second
    stage's lots are packed across groups; branches with most articles come first.
    """
    began = articles.withColumn(text, requests.led_in(text, lead_in)).withColumn(tokens, X.n_tokens(text)) if lead_in else articles
    one = classify(began, first, list(branches), group, key, text, tokens, fixed, batched).select(key, F.get("themes", F.lit(0)).alias("branch"))
    routed = store.written(articles.join(one, key), "routed")
    final = [b for b, leaves in branches.items() if not leaves]
    out = routed.where(F.col("branch").isNull() | F.col("branch").isin(final)).select(key, "branch", F.when(F.col("branch").isNotNull(), F.array("branch")).otherwise(F.array().cast("array<string>")).alias("themes"))
    for branch in largest_first(routed, branches):
        part = classify(routed.where(F.col("branch") == branch), second, branches[branch], "branch", key, text, tokens, fixed, batched)
        out = out.union(part.select(key, F.lit(branch).alias("branch"), "themes"))
    return out


def largest_first(routed: DataFrame, branches: dict[str, list[str]]) -> list[str]:
    """Branches with leaves that have articles, by falling number of these."""
    n = {r.branch: r["count"] for r in routed.groupBy("branch").count().collect()}
    return sorted((b for b, leaves in branches.items() if leaves and n.get(b)), key=lambda b: (-n[b], b))


def in_order(results: DataFrame, articles: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """Results in the order of the articles, whatever order they came in."""
    return results.join(articles.select(key, pos), key).orderBy(pos).drop(pos)


def label_codes(themes: DataFrame, names: DataFrame, label: str = "label", aliases: dict[str, str] | None = None) -> DataFrame:
    """Labels answered as text to codes; one label may have several codes, unknown ones are kept as null."""
    c = F.col(label)
    for a, b in (aliases or {}).items():
        c = F.when(F.col(label) == a, b).otherwise(c)
    return themes.withColumn("_l", c).join(names.select(F.col("label").alias("_l"), "code"), "_l", "left").drop("_l")


def with_fallback(strict: Client, free: Client) -> Client:
    """A local model: answers bound to the schema, and where the service refuses that (400), free ones, which ``valid`` sifts."""

    def call(items, labels):
        try:
            return strict(items, labels)
        except Refused as e:
            if e.status != 400:
                raise
            return free(items, labels)

    return call

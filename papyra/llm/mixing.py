"""Mixing sources to target weights by weighted sampling without replacement.

A source whose target is e + f times its size gives every document e times
(complete epochs), then takes documents in the order of their exponential keys
``-ln(u) / w`` (Efraimidis-Spirakis; w is the document's quality weight) until
the rest of the budget is used up; the last one is taken in part, so that each
source meets its target to the word.

All is DataFrame code. The order within a source is never one sort: keys fall
into SPLIT bins a source, bins are summed map-side and prefix-summed, and the bin
in which a source's budget ends is cut into SPLIT bins again, and again, until it
holds BIN_ROWS rows or fewer; only these are sorted. Bins are even between the
least and the largest key within them, so skewed weights cost rounds and no more.
Rows of equal keys are cut on in the same way by a hash of their text, and rows
equal in that too by one of their place in the table written first, so that a
source, or a key, with a third of all rows is no hot task.

Defined results: sizes of null or empty texts are 0, a very long text is counted
whole; the null source is a source and comes last; a weight that is null, NaN or
not positive counts as 1; equal keys go by the hash of their text; rows that
repeat a key are taken as rows of their own; a null key is a key; an empty table
gives an empty mix. Carried columns named like result columns give way to them;
``packed`` carries the whole row as a struct, whatever its columns are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

MAX_EPOCHS = 3
#: Documents of a source that are sorted by one task, at most, and bins that it is cut into until then.
BIN_ROWS = 2048
SPLIT = 1024
#: Weights of a document by ``labels.quality``.
QUALITY = {1: 2.0, 0: 0.5}
SEED = "mix-1"


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(key: str, seed: str = SEED) -> Column:
    """A number in (0, 1) from the key; the same in any SQL engine that has md5."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def packed(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """(row, doc_id, source, _size, _tie): ``row`` holds all columns of ``docs``; the text is counted and hashed before it travels."""
    own = F.struct(*docs.columns).alias("row")
    return docs.select(own, F.col(key).alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("_size"), F.xxhash64(text).alias("_tie"))


def quality_weights(docs: DataFrame, labels: DataFrame, key: str = "doc_id", weight: str = "_weight") -> DataFrame:
    """``docs`` with the weight of its label; 1 without one. A column of that name is replaced."""
    q = labels.groupBy(F.col(key).alias("_k")).agg(F.max("quality").alias("_q"))
    of = F.when(q["_q"] == 1, QUALITY[1]).when(q["_q"] == 0, QUALITY[0]).otherwise(1.0)
    keep = [docs[c] for c in store.free(docs.columns, [weight])]
    return docs.join(q, docs[key] == q["_k"], "left").select(*keep, of.alias(weight))


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to (source, source_size): shares by weights 1, 2, 3, ... that stop at a multiple of the size.

    What an even level by weight would give beyond the cap is shared among the
    others again; in the order of cap / weight the level is found in one scan.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    table = sizes.withColumn("_rank", rank).withColumn("_w", ((F.col("_rank") - 1) % 3 + 1).cast("double")).withColumn("_cap", cap)
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    full = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()).cast("double")
    level = table.withColumn("_level", (total - full) / rest).withColumn("_pos", F.row_number().over(order))
    ok = F.min(F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.struct("_pos", "_level"))).over(Window.partitionBy())
    return level.withColumn("_at", ok["_level"]).select("source", "source_size", F.least("_cap", F.coalesce(F.col("_at") * F.col("_w"), "_cap")).alias("target"))


def _cell(value: str) -> Column:
    """Which of SPLIT even bins between _lo and _hi a value lies in."""
    part = (F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    return F.least(F.floor(F.coalesce(part, F.lit(0.0)) * SPLIT), F.lit(SPLIT - 1)).cast("int")


def _ends(rows: DataFrame, plan: DataFrame, bin_rows: int) -> DataFrame:
    """Where each source's budget ends: (_source, _p.._r, _done), the rows before by each coordinate, and the words they hold.

    ``_p0 <= _order <= _p1`` and so on bound the last rows, which are sorted; all below come before.
    """
    # the open bin of each source: bounds of the three coordinates, words before it
    box = rows.groupBy(F.col("source").alias("_source")).agg(*(f(c).alias(f"_{n}{k}") for n, c in zip("pqr", ("_order", "_tie", "_row")) for k, f in ((0, F.min), (1, F.max))), F.count("*").alias("_n"))
    budget = plan.select(F.col("source").alias("_s"), "_budget")
    box = store.written(box.join(budget, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_done", F.lit(0).cast("long")), "box")
    while True:
        # the first coordinate that still differs within the bin
        at = F.when(F.col("_p0") < F.col("_p1"), 0).when(F.col("_q0") < F.col("_q1"), 1).when(F.col("_r0") < F.col("_r1"), 2).otherwise(3)
        box = box.withColumn("_at", at)
        large = box.where((F.col("_n") > bin_rows) & (F.col("_at") < 3) & (F.col("_budget") > F.col("_done")))
        if large.isEmpty():
            return box
        pick = lambda k: F.when(F.col("_at") == 0, F.col(f"_p{k}")).when(F.col("_at") == 1, F.col(f"_q{k}")).otherwise(F.col(f"_r{k}"))
        large = large.withColumns({"_lo": pick(0), "_hi": pick(1)})
        inside = F.col("source").eqNullSafe(F.col("_source")) & F.col("_order").between(F.col("_p0"), F.col("_p1")) & F.col("_tie").between(F.col("_q0"), F.col("_q1")) & F.col("_row").between(F.col("_r0"), F.col("_r1"))
        met = rows.join(large.drop("_n"), inside).withColumn("_v", F.when(F.col("_at") == 0, F.col("_order")).when(F.col("_at") == 1, F.col("_tie")).otherwise(F.col("_row")))
        bounds = [f(c).alias(f"_{n}{k}") for n, c in zip("pqr", ("_order", "_tie", "_row")) for k, f in ((0, F.min), (1, F.max))]
        cells = met.groupBy("_source", "_budget", "_done", _cell("_v").alias("_cell")).agg(F.sum("size").alias("_words"), F.count("*").alias("_n"), *bounds)
        line = Window.partitionBy("_source").orderBy("_cell")
        before = cells.withColumn("_before", F.col("_done") + F.sum("_words").over(line) - F.col("_words"))
        # the last bin that begins below the budget; there is one, as the first does
        last = before.where(F.col("_before") < F.col("_budget")).groupBy("_source").agg(F.max_by(F.struct(*(f"_{n}{k}" for n in "pqr" for k in (0, 1)), "_n", "_budget", F.col("_before").alias("_done")), "_cell").alias("b"))
        cut = last.select("_source", "b.*").select(*[c for c in box.columns if c != "_at"])
        rest = box.where(~((F.col("_n") > bin_rows) & (F.col("_at") < 3) & (F.col("_budget") > F.col("_done")))).drop("_at")
        box = store.written(rest.union(cut.select(*rest.columns)), "box")


def mix(docs: DataFrame, carry: list[str], text: str = "text", source: str = "source", key: str = "doc_id", weight: str | None = None, size: str | None = None, tie: str | None = None, max_epochs: int = MAX_EPOCHS, bin_rows: int = BIN_ROWS) -> DataFrame:
    """The ``carry`` columns with size, source_size, target, epochs and taken, for every row.

    ``size`` and ``tie`` name columns with the words of each row and a hash of its text, if
    they are there already.
    """
    result = ["size", "source_size", "target", "epochs", "taken"]
    carry = store.free(carry, result)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    w = F.when((w > 0) & ~F.isnan(w), w).otherwise(1.0)
    share = lambda c: (F.shiftrightunsigned(c, 11).cast("double") / F.lit(float(1 << 53)))
    rows = docs.select(
        *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)), F.col(source).alias("source"), (F.col(size) if size else n_words(text)).alias("size"), (-F.log(uniform(key)) / w).alias("_order"),
        share(F.col(tie) if tie else F.xxhash64(text)).alias("_tie"), share(F.xxhash64(F.monotonically_increasing_id())).alias("_row"),
    )
    rows = store.written(rows, "mix")
    sizes = store.written(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    plan = targets(sizes, max_epochs)
    some = F.col("source_size") > 0
    epochs = F.when(some, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("_budget", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5).cast("long"))
    plan = store.written(plan, "plan")
    ends = _ends(rows.select("source", "size", "_order", "_tie", "_row"), plan, bin_rows).drop("_budget", "_n", "_at")
    cuts = plan.join(ends, F.col("source").eqNullSafe(F.col("_source"))).drop("source")
    placed = rows.join(cuts, F.col("source").eqNullSafe(F.col("_source")))
    point, low, high = F.struct("_order", "_tie", "_row"), F.struct("_p0", "_q0", "_r0"), F.struct("_p1", "_q1", "_r1")
    # the open bin is a box of coordinates that agree in all but the one last cut by
    below, above = point < low, point > high
    out = [*(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)), "size", "source_size", "target", "epochs"]
    closed = below | above | (F.col("_budget") <= F.col("_done"))
    whole = placed.where(closed).select(*out, (F.col("epochs") * F.col("size") + F.when(below & (F.col("_budget") > 0), F.col("size")).otherwise(0)).alias("taken"))
    line = Window.partitionBy("source").orderBy("_order", "_tie", "_row").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum("size").over(line), F.lit(0)) + F.col("_done")
    part = F.greatest(F.lit(0), F.least("size", F.col("_budget") - used))
    return whole.union(placed.where(~closed).select(*out, (F.col("epochs") * F.col("size") + part).alias("taken")))


def materialise(mixed: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The ``row`` structs of a mix of ``packed`` rows, as often as the mix takes them; a part of a document is its first words."""
    columns = mixed.schema["row"].dataType.names
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.col("epochs")).cast("int")
    whole = mixed.where(times > 0).select("row", F.explode(F.sequence(F.lit(1), times))).select("row.*")
    words = F.regexp_extract_all(F.col("row")[text], F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.array_join(F.slice(words, F.lit(1), part.cast("int")), " ")
    cut = mixed.where(part > 0).select("row", head.alias("head"))
    changed = {text: F.col("head"), n_chars: F.length("head").cast("long")}
    return whole.unionByName(cut.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in columns)))


#: DuckDB SQL for the mix of ``documents``.
ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / CASE (SELECT max(quality) FROM labels l WHERE l.doc_id = documents.doc_id) WHEN 1 THEN {QUALITY[1]} WHEN 0 THEN {QUALITY[0]} ELSE 1.0 END AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, source_size * {MAX_EPOCHS}.0::DOUBLE AS cap,
    row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER (ORDER BY cap / w, rk) AS pos FROM w),
t AS (SELECT source, source_size, least(cap, w * (SELECT arg_min(level, pos) FROM l WHERE level <= cap / w)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
p AS (SELECT d.*, source_size, target, epochs, floor(target - epochs * source_size + 0.5)::BIGINT AS budget,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - used)))::BIGINT AS taken FROM p
"""

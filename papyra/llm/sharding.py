"""Sharding by extendible hashing.

A document's place is the first bits of a hash of its key. The directory starts
as one bucket; a bucket that is over the byte limit and has several documents
splits on its next bit, until none is. Sizes of all prefixes come from one
aggregation over cells of a depth at which most buckets fit; only documents of
cells that are still too large are looked at with more bits.

Documents whose hashes agree in all BITS bits (repeated keys) are parted in the
same way by BITS more: of a hash of the text, and after these of a hash of the
place in a table written first, so that equal rows part too and a retry moves no
row. The second and third directories' bits follow the first's after a full stop.
A single document over the limit is a shard of its own.

Defined results: a null text has 0 bytes; a null key hashes like an empty one; a
very long text is weighed, not cut; rows that repeat a key lie together as far as
the limit allows; an empty table gives no rows; other input columns are not carried
along unless named, and named ones give way to result columns of the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

BITS = 60
SHARD_BYTES = 1 << 20
#: Bits beyond an even split that the first aggregation looks at.
SLACK = 5
STEP = 12


def hash_bits(key: str) -> Column:
    """60 bits from the key's md5, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _prefix(h: str | Column, depth: Column | int) -> Column:
    shift = F.lit(BITS) - depth if isinstance(depth, Column) else F.lit(BITS - depth)
    return F.call_function("shiftright", F.col(h) if isinstance(h, str) else h, shift.cast("int"))


def _large(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """(root, depth, prefix) of the buckets of depths low..high that have to split; cells: (root, cell of depth high, bytes, docs)."""
    levels = cells.select("root", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"), "cell", "bytes", "docs")
    prefix = F.call_function("shiftright", F.col("cell"), (F.lit(high) - F.col("depth")).cast("int"))
    sums = levels.groupBy("root", "depth", prefix.alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"))
    return sums.where((F.col("bytes") > limit) & (F.col("docs") > 1)).select("root", "depth", "prefix")


def directory(rows: DataFrame, limit: int = SHARD_BYTES) -> tuple[DataFrame, list[int]]:
    """Buckets that split, as (root, depth, prefix), and the depths at which cells were cut; rows: (root, h, bytes).

    Every ``root`` is a directory of its own.
    """
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    high = min(BITS, max(0, math.ceil(math.log2(max(total, 1) / limit))) + SLACK) if total > limit else 0
    low, found, cuts = 0, None, []
    while True:
        cells = rows.groupBy("root", _prefix("h", high).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs"))
        large = store.written(_large(cells, low, high, limit), "large")
        found = large if found is None else found.union(large)
        cuts.append(high)
        deeper = large.where(F.col("depth") == high).select(F.col("root").alias("r"), "prefix")
        if high == BITS or deeper.isEmpty():
            return found, cuts
        rows = rows.join(deeper, (F.col("root") == F.col("r")) & (_prefix("h", high) == F.col("prefix")), "left_semi")
        low, high = high + 1, min(BITS, high + STEP)


def _with_depth(rows: DataFrame, thin: DataFrame, limit: int, name: str) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` with their depth in the directory of (root, h), and the (root, h) whose bits don't suffice."""
    large, cuts = directory(thin, limit)
    # a document's depth is the number of its buckets that split; they are counted by cell
    depth = F.lit(0)
    for low, high in zip([-1, *cuts], cuts):
        cells = large.where((F.col("depth") > low) & (F.col("depth") <= high))
        if low >= 0 and cells.isEmpty():
            continue
        base = thin.select("root", _prefix("h", high).alias("cell")).distinct()
        levels = base.select("root", "cell", F.explode(F.sequence(F.lit(low + 1), F.lit(high))).alias("depth"))
        prefix = F.call_function("shiftright", F.col("cell"), (F.lit(high) - F.col("depth")).cast("int"))
        hits = levels.withColumn("prefix", prefix).join(cells, ["root", "depth", "prefix"], "left_semi").groupBy("root", "cell").agg(F.count("*").alias(f"{name}{high}"))
        hits = hits.withColumnsRenamed({"root": "_r", "cell": "_p"})
        rows = rows.join(hits, (F.col("root") == F.col("_r")) & (_prefix("h", high) == F.col("_p")), "left").drop("_r", "_p")
        depth = depth + F.coalesce(F.col(f"{name}{high}"), F.lit(0))
    rows = rows.withColumn(name, F.least(depth.cast("int"), F.lit(BITS)))
    full = large.where(F.col("depth") == BITS).select("root", F.col("prefix").alias("h"))
    return rows, None if BITS not in cuts or full.isEmpty() else full


def _bits(depth: Column) -> Column:
    padded = F.lpad(F.bin("h"), BITS, "0")
    return F.when(depth == 0, "").otherwise(F.substring(padded, F.lit(1), depth))


def shard(docs: DataFrame, carry: list[str], text: str = "text", key: str = "doc_id", limit: int = SHARD_BYTES) -> DataFrame:
    """The ``carry`` columns with n_bytes, shard_depth and shard (its prefix bits, ``root`` for none) for every row."""
    carry = store.free(carry, ["n_bytes", "shard_depth", "shard"])
    keep = [F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)]
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes")
    rows = docs.select(*keep, F.lit(0).cast("long").alias("root"), hash_bits(key).alias("h"), size, F.col(key).alias("_key"), F.col(text).alias("_text"))
    thin = store.written(rows.select("root", "h", "bytes"), "hashes")
    carried = [f"_c{i}" for i in range(len(carry))]
    placed, full = _with_depth(rows, thin, limit, "_d")
    named = F.when(F.col("_d") == 0, "root").otherwise(_bits(F.col("_d")))
    done = placed.select(*carried, "bytes", F.col("_d").alias("depth"), named.alias("shard"), "h", "_text")
    out, rest = [], done
    for kind in ("text", "place"):
        if full is None:
            break
        over = full.select(F.col("h").alias("_h"), "root") if not out else full.select(F.col("h").alias("_h"), F.col("root").alias("_root"))
        if not out:  # bits of the first directory are used up: go on by text
            hot = rest.join(over.select("_h"), F.col("h") == F.col("_h"), "left_semi")
            again = hot.select(*carried, "bytes", F.col("h").alias("root"), "shard", F.conv(F.substring(F.md5(F.coalesce("_text", F.lit(""))), 1, 15), 16, 10).cast("long").alias("h"))
            rest = rest.join(over.select("_h"), F.col("h") == F.col("_h"), "left_anti")
        else:  # equal rows: by place
            same = (F.col("root") == F.col("_root")) & (F.col("h") == F.col("_h"))
            hot = rest.join(over, same, "left_semi")
            place = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - BITS)
            again = hot.select(*carried, "bytes", F.xxhash64("root", "h").alias("root"), "shard", place.alias("h"))
            rest = rest.join(over, same, "left_anti")
        out.append(rest.select(*carried, "bytes", "depth", "shard"))
        again = store.written(again, kind)
        deep, full = _with_depth(again, again.select("root", "h", "bytes"), limit, "_d")
        rest = deep.select(*carried, "bytes", F.lit(BITS).alias("depth"), F.concat("shard", F.lit("."), _bits(F.col("_d"))).alias("shard"), "root", "h")
    out.append(rest.select(*carried, "bytes", "depth", "shard"))
    every = out[0]
    for part in out[1:]:
        every = every.union(part)
    return every.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)), F.col("bytes").alias("n_bytes"), F.col("depth").cast("int").alias("shard_depth"), "shard")


#: DuckDB SQL for the shards of ``documents`` (distinct keys).
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
v AS (SELECT doc_id, h, n_bytes, x.depth, h >> ({BITS} - x.depth) AS prefix FROM d, (SELECT unnest(range(0, {BITS + 1}))::INT AS depth) x),
o AS (SELECT depth, prefix FROM v GROUP BY ALL HAVING sum(n_bytes) > {SHARD_BYTES} AND count(*) > 1),
c AS (SELECT v.doc_id, count(*)::INT AS n FROM v JOIN o USING (depth, prefix) GROUP BY 1)
SELECT d.doc_id, n_bytes, coalesce(n, 0)::INT AS shard_depth,
  CASE WHEN coalesce(n, 0) = 0 THEN 'root' ELSE right(lpad(bin(h >> ({BITS} - n)), {BITS}, '0'), n) END AS shard
FROM d LEFT JOIN c USING (doc_id)
"""

"""Writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.store import written


def by_issue(df: DataFrame, path: str, issue: str = "fascicule", kind: str = "json") -> None:
    """One folder per issue; rewriting some issues leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(issue).format(kind).save(path)


def csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A summary table with its columns in order."""
    df.select(*columns).write.mode("overwrite").csv(path, header=True, escape='"')


def training_text(docs: DataFrame, path: str, key: str = "doc_id", tokens: str = "tokens") -> None:
    """``id <tab> no_label <tab> tokens``, one document a line."""
    docs.select(F.concat_ws("\t", F.col(key).cast("string"), F.lit("no_label"), F.array_join(tokens, " "))).write.mode("overwrite").text(path)


def reference_corpus(docs: DataFrame, path: str, tokens: str = "tokens") -> None:
    docs.select(F.array_join(tokens, " ")).write.mode("overwrite").text(path)


def run_tables(path: str, run_id: str, **tables: DataFrame) -> None:
    """A run's topics, document topics and metadata, each a table partitioned by run."""
    for name, df in tables.items():
        df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/{name}")


def markdown(df: DataFrame, title: str, most: int = 10_000) -> str:
    """A small table as Markdown; more than ``most`` rows are an error, since the driver formats them."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a Markdown table of more than {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([f"# {title}", "", line(df.columns), line(["---"] * len(df.columns)), *map(line, rows), ""])


def two_columns(sections: list[tuple[str, int]]) -> tuple[list[str], list[str]]:
    """Names of sections with their lengths in two columns of like length: each goes, longest first, to the shorter one."""
    sides, size = ([], []), [0, 0]
    for name, n in sorted(sections, key=lambda s: -s[1]):
        at = int(size[1] < size[0])
        sides[at].append(name)
        size[at] += n
    return sides


def kit(items: DataFrame, title: str, item: str = "item", body: str = "text", candidates: str = "candidates") -> str:
    """A trial as Markdown, one second-level heading per item and its candidates in bold; ``tables.kit_items`` reads it."""
    rows = items.select(item, body, candidates).orderBy(item).collect()
    parts = [f"## {r[0]}\n\n{r[1] or ''}\n\n" + " ".join(f"**{c}**" for c in r[2] or []) for r in rows]
    return "\n\n".join([f"# {title}", *parts, ""])


def checkpointed(items: DataFrame, path: str, key: str, work, rows: int = 1000) -> int:
    """Work through the items that ``path`` has no successful result of, in slices of about ``rows``, each appended when done.

    ``work`` makes (key, ..., error) of (key, ...). A run that stops loses one slice; the next one goes on. Returns the slices done.
    """
    from papyra.streaming import windows

    spark = items.sparkSession
    store = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = store.getFileSystem(spark._jsc.hadoopConfiguration()).exists(store)
    left = windows.pending(items, spark.read.parquet(path), key) if there else items
    slices = -(-left.count() // rows)
    cut = left.withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(max(slices, 1))))
    cut = written(cut, "left")
    for i in range(slices):
        work(cut.where(F.col("_slice") == i).drop("_slice")).write.mode("append").parquet(path)
    return slices

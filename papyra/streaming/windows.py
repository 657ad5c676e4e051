"""Streaming twins of the batch aggregates, and resumable writing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def counts(events: DataFrame, width: str, late: str = "1 hour", time: str = "ts", kind: str = "event_type") -> DataFrame:
    """(start, kind, n) per tumbling window; a watermark bounds the state."""
    per = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"))
    return per.select(F.col("window.start").cast("timestamp_ntz").alias("start"), kind, "n")


def run_once(spark: SparkSession, path: str, width: str) -> DataFrame:
    """Stream a table through ``counts`` to its end and return the result."""
    folder, _, name = path.rpartition("/")
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else f"{folder}/{name[:-8]}*.parquet")
    table = f"counts_{uuid.uuid4().hex}"
    q = counts(stream, width).writeStream.outputMode("complete").format("memory").queryName(table).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(table)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def pending(items: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Items without a successful result: failed ones (with ``error``) are tried again."""
    return items.join(results.where("error IS NULL").select(key).distinct(), key, "left_anti")


def latest(answers: DataFrame, key: str, *order: str) -> DataFrame:
    """The last answer of each item."""
    return answers.groupBy(key).agg(F.max_by(F.struct(*answers.columns), F.struct(*order)).alias("r")).select("r.*")


def resume_into(stream: DataFrame, key: str, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], work: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Process a stream of items batch by batch; a replayed batch skips what the sink already has."""

    def step(batch: DataFrame, _: int) -> None:
        write(work(pending(batch, read(), key)))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)

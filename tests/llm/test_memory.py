"""What executors hold beside their heaps: batches to Python, and the workers' arrays."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from papyra.llm import simhash, store

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture(autouse=True)
def unset(spark):
    """Other tests of the session may have run the pipeline."""
    spark.conf.unset(BATCH)
    yield
    spark.conf.unset(BATCH)


def _sizes(frame):
    """Rows and bytes of each batch that Python gets; workers can't import this module."""

    def run(batches):
        for batch in batches:
            yield pa.record_batch({"n": np.array([batch.num_rows]), "b": np.array([batch.nbytes])})

    return frame.mapInArrow(run, "n long, b long")


def test_written_tables_take_small_batches(spark):
    texts = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("word "), 1000).cast("binary").alias("text"))
    got = store.written(_sizes(texts), "sizes").agg(F.sum("n"), F.max("b")).first()
    assert got[0] == 4000 and got[1] < 4 << 20
    assert spark.conf.get(BATCH, None) is None


def test_the_sessions_own_batches_hold(spark):
    spark.conf.set(BATCH, "65536")
    store.small_batches(spark)
    store.written(spark.range(3), "three")
    assert spark.conf.get(BATCH) == "65536"


def test_stages_that_return_python_frames_bound_their_batches(spark):
    docs = spark.createDataFrame([(i, "a b c " * 2000) for i in range(2000)], "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(0, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.mode("overwrite").parquet(f"{store.shared_dir(spark)}/in/labels.parquet")
    corpus_pipeline.toxic_documents_go(spark, docs, f"{store.shared_dir(spark)}/in")
    assert _sizes(docs.select(F.col("text").cast("binary"))).agg(F.max("b")).first()[0] < 4 << 20


def test_sketches_take_few_bytes_at_once():
    texts = [b" ".join(b"w%d" % (i * 7919 + j) for j in range(300)) for i in range(2000)]
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.ones(1 << 16, np.int64)
    run = simhash._sketches(simhash.SHINGLE, *none)
    batch = pa.record_batch({"doc_id": np.arange(2000), "th": np.arange(2000), "text": pa.array(texts, pa.binary())})
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 2000 and peak < 40 << 20

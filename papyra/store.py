"""Tables that are written once and read several times.

Everything goes to the folder the cluster names in ``spark.checkpoint.dir``,
which driver and executors share, so that a lost executor never loses a stage.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: With this setting Spark drops a finished query's shuffle files at once.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a batch that goes to Python at once, about: executors buffer several outside their heaps. A session's own setting holds.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20

_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; one of our own only where none is set and nothing is remote."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="papyra-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def small_batches(spark: SparkSession) -> None:
    """From now on the session's batches to Python are bounded, for frames that someone else writes."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/papyra-{name}-{uuid.uuid4().hex}"
    before, batch = spark.conf.get(CLEANUP, "false"), spark.conf.get(BATCH, None)
    spark.conf.set(CLEANUP, "true")
    small_batches(spark)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
        if batch is None:
            spark.conf.unset(BATCH)
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = []
        atexit.register(drop_written, spark)
    _made[app].append(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession, rows: int, per_task: int) -> int:
    """How many tasks ``rows`` need, at the session's number of shuffle partitions or more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a frame that ``written`` returned."""
    for f in df.inputFiles()[:1]:
        _delete(spark, f.rsplit("/", 1)[0])


def _delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def drop_written(spark: SparkSession) -> None:
    """Delete every table this session has written; also runs at exit."""
    try:
        for path in _made.pop(spark.sparkContext.applicationId, []):
            _delete(spark, path)
    except Exception as stopped:  # the session may be gone at interpreter exit
        del stopped

"""Named queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: SQL shared by the checks. w(t): words; tok(t): estimated tokens.
WORDS = "list_filter(string_split_regex(coalesce({0}, ''), '[ \\t\\r\\n]+'), lambda x: x <> '')"
TOK = "(floor(length(coalesce({0}, '')) / 3.5) + 1)::BIGINT"


def spread(df: DataFrame) -> DataFrame:
    """Texts of fewer splits than cores are dealt out before each is exploded into many words; larger inputs stay as read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


class Tables:
    """Lazy access to the tables of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def small(self, rows: list[tuple], schema: str) -> DataFrame:
        """A frame of a few rows of the driver's; it starts no Python worker, as one made from a list does."""
        kind = _parse_datatype_string(schema)
        columns = list(zip(*rows)) or [()] * len(kind.fields)
        table = pa.table([pa.array(c, type=to_arrow_type(f.dataType)) for c, f in zip(columns, kind.fields)], names=kind.names)
        return self.spark.createDataFrame(table, kind)

    def texts(self, *columns: str) -> DataFrame:
        """``columns`` of ``documents``, for queries that take every text apart."""
        return spread(self.documents.select(*columns))


def query(sql: str | None = None):
    """Register a function of Tables under its name, with its check if SQL can express it."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql.replace("{w}", WORDS.format("text")).replace("{tok}", TOK.format("text"))
        return f

    return add

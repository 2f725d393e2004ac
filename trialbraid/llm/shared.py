"""Tables between jobs, in the folder all machines of a cluster share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a stored table, or values in its arrays, that may be broadcast (tens of megabytes).
BROADCAST_VALUES = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application under ``spark.checkpoint.dir``, where unset under the warehouse.

    It may be removed when the application has ended.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/trialbraid-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession) -> str:
    """The path of a new table or folder in the shared folder."""
    return f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a frame and read it again.

    That cuts the lineage, survives lost executors, and gives the optimizer
    the true size, so that it broadcasts only what is small.
    """
    path = path or scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Removes the shuffle files of a query at its end instead of when the driver collects garbage.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of a batch of rows for Python; both the executor and the worker hold a few of them.
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def _held(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def tidy(spark: SparkSession) -> AbstractContextManager[None]:
    """Queries run inside leave no shuffle files. What must stay is to be stored."""
    return _held(spark, _TIDY, "true")


def small_batches(spark: SparkSession, size: int = 8 << 20) -> AbstractContextManager[None]:
    """Queries run inside hand Python batches of about ``size`` bytes, or of one row."""
    return _held(spark, _BATCH_BYTES, str(size))


def removed(spark: SparkSession, path: str) -> None:
    """Remove what is stored at a path of ``scratch``, when no later job reads it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(table: DataFrame, values: str = "count(*)") -> DataFrame:
    """A stored table, marked for broadcast if it is measured as small.

    ``values`` is an aggregate that bounds what a broadcast would hold. A
    larger table takes part in a sort-merge join instead.
    """
    measured = table.selectExpr(f"{values} AS n").first().n or 0
    return F.broadcast(table) if measured <= BROADCAST_VALUES else table

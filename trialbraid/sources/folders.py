"""Folders for tables that later jobs of this application read."""

from __future__ import annotations

from pyspark.sql import SparkSession


def work_folder(spark: SparkSession, name: str) -> str:
    """A folder all executors share, for tables that later jobs of this application read.

    It lies under ``spark.checkpoint.dir`` where the cluster names one, else
    under the warehouse; the next use under the same name overwrites it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/trialbraid-{spark.sparkContext.applicationId}/{name}"

"""Cutting the lineage of intermediate results in a way that survives lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one below the session's warehouse where none is set."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"


def durable(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def freed(table: DataFrame) -> DataFrame:
    """The written table; the shuffle files of the step that wrote it go now, not when the driver's heap is full.

    Spark removes them once the driver has collected the step's plan, which a large heap puts off for many steps.
    """
    table.sparkSession.sparkContext._jvm.System.gc()
    return table


def stored(df: DataFrame) -> DataFrame:
    """Written to the shared folder as compressed Parquet and read again; for results of the input's size."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from bankrec.session import ensure_checkpoint_dir


def stored(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write rows once as Parquet below the cluster's checkpoint folder and read them back.
    This cuts the lineage, and later reads survive the loss of an executor."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)

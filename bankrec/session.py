"""Session settings the operators expect."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName("bankrec")
    if master:
        builder = builder.master(master)
    settings = dict(SETTINGS)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(extra)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a session somebody else started."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's shared checkpoint folder. One on this machine is picked only where
    none is named and all tasks run in this process; on a cluster that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        alone = context.master == "local" or context.master.startswith("local[")
        if not named and not alone:
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="run-"))


def shared_folder(spark: SparkSession) -> str:
    """A folder of its own below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def stored(rows: DataFrame) -> DataFrame:
    """Rows written once to a shared folder and read from there. As ``checkpoint()`` this cuts
    the lineage, but columns are packed, and each later use reads only those it needs."""
    folder = shared_folder(rows.sparkSession)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def task_count(spark: SparkSession) -> int:
    """Tasks for work that is heavy for its few bytes, which would otherwise be
    gathered into one task."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")),
               spark.sparkContext.defaultParallelism)


def deal_out(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt out to ``task_count`` tasks by a hash of their own, so that an
    earlier partitioning by ``key`` does not stand in for it."""
    return rows.repartition(task_count(rows.sparkSession), F.xxhash64(key))

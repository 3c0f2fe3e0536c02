"""Error lines of log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: what makes a log line worth keeping.
ERROR_PATTERN = "(?i)error|exception|traceback|critical"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, value)`` of the lines of every ``.log`` file under a folder."""
    return (spark.read.option("pathGlobFilter", "*.log").option("recursiveFileLookup", "true")
            .text(folder).select(F.input_file_name().alias("path"), "value"))


def error_lines(linhas: DataFrame) -> DataFrame:
    """``(dia, ficheiro, value)``: error lines with the day of their folder."""
    day = F.regexp_extract("path", r"/(\d{4}-\d{2}-\d{2})/[^/]*$", 1).try_cast("date")
    return (linhas.where(F.col("value").rlike(ERROR_PATTERN))
            .select(day.alias("dia"), F.regexp_extract("path", r"([^/]+)$", 1).alias("ficheiro"), "value"))


def archive(linhas: DataFrame, out: str) -> None:
    """Write log lines compressed, one folder per day."""
    day = F.regexp_extract("path", r"/(\d{4}-\d{2}-\d{2})/[^/]*$", 1)
    (linhas.select(day.alias("dia"), "value").write.mode("overwrite").partitionBy("dia")
     .option("partitionOverwriteMode", "dynamic").option("compression", "gzip").text(out))

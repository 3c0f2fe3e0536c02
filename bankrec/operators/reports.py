"""Long-form series and display labels for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankrec.functions.values import SERIES_LABELS, STATE_LABELS, STATUS_LABELS, label


def unpivot_series(df: DataFrame, ids: list[str], columns: list[str],
                   labelled: bool = True) -> DataFrame:
    """One row per id and series ``(ids..., tipo, valor)``."""
    long = df.unpivot(ids, columns, "tipo", "valor")
    return long.withColumn("tipo", label("tipo", SERIES_LABELS)) if labelled else long


def status_badge(scripts: DataFrame) -> DataFrame:
    """Script status as shown to people; being late overrides the status."""
    late = F.concat(F.lit("⏰ Atrasado (esperado "), F.col("hora_em_falta"), F.lit(")"))
    return scripts.withColumn("status_badge", F.when(F.col("atrasado"), late)
                              .otherwise(label("status", STATUS_LABELS)))


def state_report(counts: DataFrame) -> DataFrame:
    """Movements per day and state, states as shown to people."""
    return counts.withColumn("estado", label("estado", STATE_LABELS))

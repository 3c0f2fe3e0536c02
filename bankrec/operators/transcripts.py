"""Conversations folded into the answer and the tools called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankrec.functions.text import strip


def fold(transcricoes: DataFrame) -> DataFrame:
    """``(conv_id, resposta, ferramentas)``, one row per conversation: text pieces joined
    in order and stripped at the ends, and names of the tool rows in order."""
    is_tool = F.col("role") == "tool"
    piece = F.struct("turn", F.when(~is_tool, F.coalesce("text", F.lit(""))).alias("t"),
                     F.when(is_tool, F.col("name")).alias("n"))
    whole = transcricoes.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("p"))

    def joined(field: str) -> Column:
        kept = F.filter("p", lambda x: x[field].isNotNull() & (x[field] != ""))
        return F.transform(kept, lambda x: x[field])

    return whole.select("conv_id", strip(F.array_join(joined("t"), "")).alias("resposta"),
                        joined("n").alias("ferramentas"))

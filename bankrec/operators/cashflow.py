"""Listings and cash-flow summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bankrec.functions.text import key_of
from bankrec.functions.values import payment, receipt


def companies(movimentos: DataFrame) -> DataFrame:
    return movimentos.select("empresa").distinct().orderBy("empresa")


def company_history(movimentos: DataFrame, empresa: str) -> DataFrame:
    """All movements of a company under any spelling, by day. ``chave`` is stored
    with the rows, so the test on it reaches the scan."""
    return (movimentos.where(F.col("chave") == key_of(empresa))
            .select("id", "dia", "descricao", "valor").orderBy("dia", "id"))


def daily_summary(movimentos: DataFrame) -> DataFrame:
    """Receipts (zero included) and payments per day, all companies."""
    return movimentos.groupBy("dia").agg(receipt("valor").alias("recebimentos"),
                                         payment("valor").alias("pagamentos"))


def day_totals(movimentos: DataFrame) -> DataFrame:
    """Sums and counts of strictly positive and strictly negative movements."""
    v = F.col("valor")
    return movimentos.groupBy("dia").agg(
        F.coalesce(F.sum(F.when(v > 0, v)), F.lit(0)).alias("total_recebimentos"),
        F.count_if(v > 0).alias("n_recebimentos"),
        F.coalesce(F.sum(F.when(v < 0, -v)), F.lit(0)).alias("total_pagamentos"),
        F.count_if(v < 0).alias("n_pagamentos"))


def month_to_date(movimentos: DataFrame) -> DataFrame:
    """The daily summary with the balance of its month up to each day."""
    month = F.trunc("dia", "MM")
    running = W.partitionBy(month).orderBy("dia").rowsBetween(W.unboundedPreceding, 0)
    net = F.col("recebimentos") - F.col("pagamentos")
    return daily_summary(movimentos).withColumn("balanco", F.sum(net).over(running))


def company_daily_net(movimentos: DataFrame) -> DataFrame:
    """Net flow per company key and day, labelled by sign."""
    net = movimentos.groupBy("chave", "dia").agg(F.sum("valor").alias("valor"))
    return net.withColumn("sinal", F.when(F.col("valor") >= 0, "Entradas").otherwise("Saídas"))

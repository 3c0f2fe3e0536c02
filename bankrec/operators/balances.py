"""Balances: lookups and last known values."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bankrec.functions.text import key_of
from bankrec.functions.values import order_of

_MONEY = ["saldo_contabilistico", "saldo_disponivel"]


def lookup(saldos: DataFrame, empresa: str, dia: date | None = None) -> DataFrame:
    rows = saldos.where(F.col("chave") == key_of(empresa))
    return rows if dia is None else rows.where(F.col("dia") == F.lit(dia))


def latest(saldos: DataFrame, ate_dia: date | None = None) -> DataFrame:
    """Last reading of each entity up to a day, inclusive. A null reading counts as
    the last one; several on one day are settled by id."""
    rows = saldos if ate_dia is None else saldos.where(F.col("dia") <= F.lit(ate_dia))
    order = order_of("unix_date(dia)")
    return rows.groupBy("entidade").agg(
        *[F.expr(f"max_by({c}, {order}) as {c}") for c in ("id", "dia", *_MONEY)])


def latest_between(saldos: DataFrame, inicio: date, fim: date) -> DataFrame:
    """Last reading of each entity as of every day from ``inicio`` to ``fim``.

    Each reading holds until the day before the next one, so it is expanded over
    the days it covers; the rows made are exactly the rows of the answer.
    """
    daily = (saldos.where(F.col("dia") <= F.lit(fim)).groupBy("entidade", "dia")
             .agg(F.expr("max(id) as id"), *[F.expr(f"max_by({c}, id) as {c}") for c in _MONEY]))
    following = F.lead("dia").over(W.partitionBy("entidade").orderBy("dia"))
    until = F.least(F.coalesce(F.date_sub(following, 1), F.lit(fim)), F.lit(fim))
    spans = (daily.withColumn("de", F.greatest("dia", F.lit(inicio))).withColumn("ate", until)
             .where("de <= ate"))
    return spans.select(F.explode(F.sequence("de", "ate")).alias("em"), "entidade", "dia", "id", *_MONEY)


def total(ultimos: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Number of entities and total of their last readings; null counts as 0."""
    return ultimos.groupBy(*(by or [])).agg(
        F.count("*").alias("entidades"),
        *[F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).alias(f"{c}_total") for c in _MONEY])


def top(ultimos: DataFrame, n: int = 10) -> DataFrame:
    return (ultimos.orderBy(F.desc_nulls_last("saldo_contabilistico"), "entidade").limit(n)
            .select("entidade", "dia", *_MONEY))

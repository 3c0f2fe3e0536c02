"""Daily series: positions, zero-filled cash-flow, horizons and lag features.

A series is long form ``(serie, t, dia, valor)``; ``serie`` is a company key, or
``*`` for the whole portfolio.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bankrec.functions.values import calendar, payment, receipt

PORTFOLIO = "*"
# Fixed value: the names of the lag and calendar features.
FEATURES = ["dia_semana", "dia_mes", "fim_de_semana", "lag_1", "lag_2", "lag_3", "media_movel_5"]
N_LAGS = 3
MEAN_WINDOW = 5
_IDS_PER_BLOCK = 1 << 20


def balance_series(saldos: DataFrame) -> DataFrame:
    """Ledger balances of each company key by day; ``t`` is the position, and two
    readings of one day are two positions.

    Positions come from counts per (key, day, block of ids) plus a rank inside the
    block, so a key with very many readings is still numbered by many tasks.
    """
    rows = (saldos.where("saldo_contabilistico is not null")
            .select(F.col("chave").alias("serie"), "dia", "id",
                    F.col("saldo_contabilistico").cast("double").alias("valor"),
                    F.floor(F.col("id") / _IDS_PER_BLOCK).alias("_bloco")))
    block = ["serie", "dia", "_bloco"]
    earlier = W.partitionBy("serie").orderBy("dia", "_bloco").rowsBetween(W.unboundedPreceding, -1)
    starts = (rows.groupBy(*block).agg(F.count("*").alias("_n"))
              .withColumn("_antes", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"))
    rank = F.row_number().over(W.partitionBy(*block).orderBy("id"))
    return (rows.join(starts, block).withColumn("t", F.col("_antes") + rank - 1)
            .select("serie", "t", "dia", "valor"))


def cashflow_series(movimentos: DataFrame) -> DataFrame:
    """Receipts, payments and net for every calendar day between the first and the
    last movement, for each company and the portfolio; days without movements are
    zero. Gaps are filled from each row's next day, without a calendar join."""
    daily = movimentos.groupBy("chave", "dia").agg(receipt("valor").alias("r"),
                                                   payment("valor").alias("p"))
    daily = (daily.withColumn("serie", F.explode(F.array("chave", F.lit(PORTFOLIO))))
             .groupBy("serie", "dia").agg(F.sum("r").alias("r"), F.sum("p").alias("p")))
    by_day = W.partitionBy("serie").orderBy("dia")
    until = F.coalesce(F.date_sub(F.lead("dia").over(by_day), 1), F.col("dia"))
    first = F.first("dia").over(by_day.rowsBetween(W.unboundedPreceding, 0))
    filled = (daily.withColumn("_ate", until).withColumn("_primeiro", first)
              .select("serie", "_primeiro", "r", "p",
                      F.posexplode(F.sequence("dia", "_ate")).alias("_pos", "dia")))
    real = F.col("_pos") == 0
    money = lambda c: F.when(real, F.col(c)).otherwise(F.lit(0)).cast("decimal(28,2)")
    return (filled.select("serie", F.datediff("dia", "_primeiro").cast("long").alias("t"), "dia",
                          money("r").alias("recebimentos"), money("p").alias("pagamentos"))
            .withColumn("liquido", F.col("recebimentos") - F.col("pagamentos")))


def net_series(cashflow: DataFrame) -> DataFrame:
    return cashflow.select("serie", "t", "dia", F.col("liquido").cast("double").alias("valor"))


def horizon(series: DataFrame, h: int) -> DataFrame:
    """The ``h`` days after the last one of each series."""
    last = series.groupBy("serie").agg(F.max("dia").alias("_ultimo"))
    step = F.explode(F.sequence(F.lit(1), F.lit(h))).alias("passo")
    return last.select("serie", "_ultimo", step).select(
        "serie", "passo", F.date_add("_ultimo", F.col("passo")).alias("dia"))


def features(series: DataFrame) -> DataFrame:
    """Calendar, lags and mean of the previous days, from values before each day."""
    by_t = W.partitionBy("serie").orderBy("t")
    mean = F.avg("valor").over(by_t.rowsBetween(-MEAN_WINDOW, -1))
    lags = {f"lag_{i}": F.lag("valor", i).over(by_t) for i in range(1, N_LAGS + 1)}
    return (series.withColumns({**calendar("dia"), **lags, "media_movel_5": mean})
            .where(F.col("t") >= N_LAGS).select("serie", "t", "dia", *FEATURES, "valor"))

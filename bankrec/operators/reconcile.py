"""Reconciliation of bank movements with planned lines, all days in one job.

A movement and a line can match only when day, company key and amount are equal,
so every group of equal keys is independent of the others. Within a group with n
open lines, movements in id order: n = 0 makes all of them ``novo``; n >= 2 makes
all of them ``ambiguo`` and uses no line; n = 1 makes the first one ``exato`` and
the rest ``novo``. That needs counts and one minimum, never the pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankrec import skew

KEYS = ["dia", "chave", "valor"]


def pending(movimentos: DataFrame, reconciliacoes: DataFrame) -> DataFrame:
    """Movements without any reconciliation row."""
    done = reconciliacoes.select(F.col("movimento_id").alias("id"))
    return movimentos.join(done, "id", "left_anti")


def open_lines(linhas: DataFrame) -> DataFrame:
    """Lines that can still be matched, with their planned amount as the key."""
    return (linhas.where("previsto is not null and pago is null")
            .select("id", "dia", "chave", F.col("previsto").alias("valor")))


def line_groups(linhas: DataFrame) -> DataFrame:
    return (open_lines(linhas).groupBy(*KEYS)
            .agg(F.count("*").alias("n_linhas"), F.min("id").alias("linha_id")))


def movement_groups(movimentos: DataFrame) -> DataFrame:
    return movimentos.groupBy(*KEYS).agg(F.count("*").alias("n_mov"), F.min("id").alias("_primeiro"))


_STATE = """case when n_linhas is null then 'novo' when n_linhas >= 2 then 'ambiguo'
                 when id = _primeiro then 'exato' else 'novo' end"""


def classify(pendentes: DataFrame, linhas: DataFrame, min_rows: int = skew.MIN_ROWS) -> DataFrame:
    """Each pending movement with ``tipo_match``, ``linha_id`` (exact matches only),
    ``n_linhas`` and, when ambiguous, ``grupo``: the first movement id of its group.

    One aggregate per key tells all its movements what they need, and which keys are heavy.
    Movements are shuffled once; those of heavy keys, wherever they are.
    """
    groups = movement_groups(pendentes).join(line_groups(linhas).withColumnRenamed("linha_id", "_linha"), KEYS, "left")
    joined = skew.join_groups(pendentes, groups, KEYS, "n_mov", by="id", min_rows=min_rows)
    columns = pendentes.columns
    return (joined.selectExpr(*columns, "n_linhas", "_linha", "_primeiro", f"{_STATE} as tipo_match")
            .selectExpr(*columns, "n_linhas", "tipo_match",
                        "case when tipo_match = 'exato' then _linha end as linha_id",
                        "case when tipo_match = 'ambiguo' then _primeiro end as grupo"))


def reconciliations(classificados: DataFrame, ts: Column | None = None) -> DataFrame:
    when = F.current_timestamp() if ts is None else ts
    return classificados.select(F.col("id").alias("movimento_id"), "linha_id", "tipo_match",
                                when.cast("timestamp").alias("ts"), "dia")


def apply_matches(linhas: DataFrame, reconciliacoes: DataFrame, movimentos: DataFrame) -> DataFrame:
    """Lines with ``pago`` taken from the movement they were matched with. Derived
    from stored reconciliations, so running it again changes nothing."""
    exact = reconciliacoes.where("tipo_match = 'exato' and linha_id is not null")
    paid = (exact.join(movimentos.select(F.col("id").alias("movimento_id"), "valor"), "movimento_id")
            .groupBy(F.col("linha_id").alias("id")).agg(F.max("valor").alias("_valor")))
    return (linhas.join(paid, "id", "left").withColumn("pago", F.coalesce("pago", "_valor"))
            .drop("_valor").select(*linhas.columns))


def lines_after(linhas: DataFrame, classificados: DataFrame) -> DataFrame:
    """Lines as one run leaves them."""
    paid = (classificados.where("tipo_match = 'exato'")
            .select(F.col("linha_id").alias("id"), F.col("valor").alias("_valor")))
    return (linhas.join(paid, "id", "left").withColumn("pago", F.coalesce("pago", "_valor"))
            .drop("_valor").select(*linhas.columns))


def summary(pendentes: DataFrame, linhas: DataFrame, dias: DataFrame | None = None) -> DataFrame:
    """Matched, new and ambiguous movements per day, from group counts alone.
    ``dias`` lists days to report even when nothing was pending."""
    groups = movement_groups(pendentes).join(line_groups(linhas), KEYS, "left")
    n, m = F.col("n_linhas"), F.col("n_mov")
    per_day = groups.groupBy("dia").agg(
        F.sum(F.when(n == 1, 1).otherwise(0)).alias("casados"),
        F.sum(F.when(n.isNull(), m).when(n == 1, m - 1).otherwise(0)).alias("novos"),
        F.sum(F.when(n >= 2, m).otherwise(0)).alias("ambiguos"))
    if dias is None:
        return per_day
    return dias.select("dia").distinct().join(per_day, "dia", "left").fillna(0)


def audit(movimentos: DataFrame, linhas: DataFrame) -> DataFrame:
    """Per day: movements without an open line, and open lines without a movement.
    Both sides are aggregated before they meet, so no key is hot."""
    both = movement_groups(movimentos).join(line_groups(linhas), KEYS, "full_outer")
    alone = lambda n, other: F.sum(F.when(F.col(other).isNull(), F.col(n)).otherwise(0))
    return both.groupBy("dia").agg(alone("n_mov", "n_linhas").alias("sem_match_fwd"),
                                   alone("n_linhas", "n_mov").alias("sem_match_rev"))


def movement_status(movimentos: DataFrame, reconciliacoes: DataFrame, linhas: DataFrame) -> DataFrame:
    """Each movement with its first reconciliation and that line's imputation. Only
    reconciliations that have a line go through the line join, so the many without
    one never pile up on a null key."""
    # states as numbers, so that the aggregation is by hash
    states = "array('exato', 'ambiguo', 'novo')"
    first = (reconciliacoes.groupBy(F.col("movimento_id").alias("id"))
             .agg(F.expr(f"min_by(cast(array_position({states}, tipo_match) as int), struct(ts, linha_id)) as s"),
                  F.expr("min_by(linha_id, struct(ts, linha_id)) as linha_id"))
             .selectExpr("id", f"get({states}, s - 1) as tipo_match", "linha_id"))
    imputed = (first.where("linha_id is not null")
               .join(linhas.select(F.col("id").alias("linha_id"),
                                   F.col("imputacao").alias("linha_imputacao")), "linha_id")
               .select("id", "linha_id", "linha_imputacao"))
    return (movimentos.select("id", "dia", "empresa", "descricao", "valor")
            .join(first.select("id", "tipo_match"), "id", "left").join(imputed, "id", "left"))


def state_counts(estado: DataFrame) -> DataFrame:
    """Movements per day and state, all four states present; input is
    ``movement_status``."""
    t = F.col("tipo_match")
    wide = estado.groupBy("dia").agg(
        F.count_if(t == "exato").alias("exato"), F.count_if(t == "ambiguo").alias("ambiguo"),
        F.count_if(t == "novo").alias("novo"), F.count_if(t.isNull()).alias("por_processar"))
    return wide.unpivot("dia", ["exato", "ambiguo", "novo", "por_processar"], "estado", "quantidade")

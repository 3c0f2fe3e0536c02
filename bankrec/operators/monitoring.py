"""Scheduled jobs: runs, last status, and runs that did not happen."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bankrec.functions.text import strip
from bankrec.functions.values import iso_utc, order_of

ZONE = "Europe/Lisbon"
TOLERANCE_MINUTES = 20
DEFAULT_SCHEDULE = "08:00"

# The scheduled jobs, their descriptions and times.
SCRIPTS = (
    ("preencher_mapa",
     "Preenchimento do Mapa de Pagamentos e Recebimentos a partir dos extratos bancários",
     "08:50, 12:50, 14:10, 16:15, 18:30"),
    ("atualizar_mapa_saldos",
     "Atualização do Mapa de Saldos Bancários (folhas diárias)",
     "08:55, 12:55, 14:15, 16:20, 18:35"),
    ("enviar_mapa_smtp",
     "Envio diário do Mapa de Pagamentos e Recebimentos por email",
     "16:30"),
)


def configured(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCRIPTS, "nome string, descricao string, hora_execucao string")


def expected_times(scripts: DataFrame) -> DataFrame:
    """``(nome, h, m)`` for each well-formed ``HH:MM`` of a schedule."""
    part = F.explode(F.split("hora_execucao", ","))
    piece = lambda g: F.regexp_extract("parte", r"^\s*(\d+)\s*:\s*(\d+)\s*$", g).try_cast("int")
    return (scripts.select("nome", part.alias("parte"))
            .select("nome", piece(1).alias("h"), piece(2).alias("m")).where("h is not null and m is not null"))


def _moment(agora: datetime | Column) -> Column:
    """An instant; a naive datetime is UTC."""
    return agora if isinstance(agora, Column) else F.lit(agora).cast("timestamp")


def overdue(scripts: DataFrame, ultimas: DataFrame, agora: datetime | Column) -> DataFrame:
    """``(nome, atrasado, hora_em_falta)``: is the latest of today's times, with the
    tolerance gone by, without a run since? ``ultimas`` is ``(nome, ts)``."""
    now = _moment(agora)
    today = F.from_utc_timestamp(now, ZONE)
    due_at = F.try_make_timestamp(F.year(today), F.month(today), F.dayofmonth(today),
                                  F.col("h"), F.col("m"), F.lit(0), F.lit(ZONE))
    limit = now - F.expr(f"interval {TOLERANCE_MINUTES} minutes")
    due = (expected_times(scripts).select("nome", due_at.alias("devida")).where(F.col("devida") <= limit)
           .groupBy("nome").agg(F.max("devida").alias("devida")))
    late = F.col("devida").isNotNull() & (F.col("ts").isNull() | (F.col("ts") < F.col("devida")))
    return (scripts.select("nome").join(due, "nome", "left").join(ultimas, "nome", "left")
            .select("nome", late.alias("atrasado"),
                    F.when(late, F.date_format(F.from_utc_timestamp("devida", ZONE), "HH:mm"))
                    .alias("hora_em_falta")))


def last_runs(execucoes: DataFrame) -> DataFrame:
    """``(nome, status, erro, ts)`` of the last run of each script: its place is found
    by a hash aggregate, then its row by a join with that small result."""
    order = order_of("unix_micros(ts)")
    placed = execucoes.selectExpr("script as nome", "status", "erro", "ts", f"{order} as _o")
    last = placed.groupBy("nome").agg(F.expr("max(_o) as _o"))
    return placed.join(last, ["nome", "_o"]).drop("_o")


def script_status(execucoes: DataFrame, agora: datetime | Column) -> DataFrame:
    """Configured and observed scripts with their last run and whether one is missing."""
    known = configured(execucoes.sparkSession)
    last = last_runs(execucoes)
    names = known.select("nome").union(last.select("nome")).distinct()
    scripts = (names.join(known, "nome", "left")
               .withColumn("descricao", F.coalesce("descricao", F.concat(F.lit("Script "), "nome")))
               .withColumn("hora_execucao", F.coalesce("hora_execucao", F.lit(DEFAULT_SCHEDULE))))
    late = overdue(scripts, last.select("nome", F.date_trunc("second", "ts").alias("ts")), agora)
    return (scripts.join(last, "nome", "left").join(late, "nome")
            .select("nome", "descricao", "hora_execucao",
                    F.coalesce("status", F.lit("ok")).alias("status"),
                    iso_utc("ts").alias("ultima_execucao"), F.col("erro").alias("ultima_erro"),
                    "atrasado", "hora_em_falta").orderBy("nome"))


def late_scripts(status: DataFrame) -> DataFrame:
    """One row naming every late script."""
    names = F.array_sort(F.collect_list(F.when(F.col("atrasado"), F.col("nome"))))
    return status.agg(F.array_join(names, ", ").alias("atrasados"))


def recent_runs(execucoes: DataFrame, limit: int = 50) -> DataFrame:
    """The latest runs, oldest first."""
    # Fixed value: the message of a run that told none.
    default = F.concat(F.lit("Execução do script "), "script", F.lit(" registada com status "),
                       "status", F.lit("."))
    last = execucoes.orderBy(F.desc("ts"), F.desc("id")).limit(limit)
    return (last.orderBy("ts", "id")
            .select("id", iso_utc("ts").alias("timestamp"), "script",
                    F.when(F.col("status") == "erro", "erro").otherwise("info").alias("nivel"),
                    F.coalesce(F.when(F.col("erro") != "", F.col("erro")), default).alias("mensagem"),
                    F.coalesce("log", F.array().cast("array<string>")).alias("detalhe")))


def runs_of(execucoes: DataFrame, script: str, limit: int = 100) -> DataFrame:
    """Runs of one script among the latest ``limit`` runs of all scripts."""
    return recent_runs(execucoes, limit).where(F.lower("script") == script.lower())


def record_runs(novas: DataFrame) -> DataFrame:
    """Runs as they are stored: name trimmed and in lower case, log never null."""
    return (novas.withColumn("script", F.lower(strip("script")))
            .withColumn("log", F.coalesce("log", F.array().cast("array<string>"))))

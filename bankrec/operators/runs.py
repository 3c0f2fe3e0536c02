"""Reconciliation and run reports over the stored tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bankrec import schema
from bankrec.operators import cases, monitoring, reconcile
from bankrec.operators.ingest import assign_ids
from bankrec.session import ensure_checkpoint_dir


def _add_new(spark: SparkSession, root: str, name: str, rows: DataFrame, key: list[str],
             dias: list[date]) -> None:
    """Append rows whose key is not stored yet, so a repeated run adds nothing twice."""
    stored = schema.read_table(spark, root, name, dias).select(*key).distinct()
    schema.write_table(rows.join(stored, key, "left_anti").checkpoint(), root, name)


def reconcile_days(spark: SparkSession, root: str, dias: list[date] | None = None,
                   ts: Column | None = None) -> DataFrame:
    """Reconcile the pending movements of some days, or of all, and store the result.
    Only the partitions of those days are read and written. Returns matched, new and
    ambiguous counts per day; of the days named, also those with nothing pending.

    Candidates and cases are stored before the reconciliations that make their
    movements count as processed, and lines are paid from stored reconciliations
    last. A run that stops anywhere is completed by running it again.
    """
    ensure_checkpoint_dir(spark)
    read = lambda name: schema.read_table(spark, root, name, dias)
    settle_lines(read("movimentos"), read("linhas"), read("reconciliacoes"), root)
    pending = reconcile.pending(read("movimentos"), read("reconciliacoes"))
    classified = reconcile.classify(pending, read("linhas")).checkpoint()
    touched = schema.days_of(classified)
    options = cases.candidates(classified, read("linhas"))
    _add_new(spark, root, "candidatos", options, ["dia", "grupo", "linha_id"], touched)
    _add_new(spark, root, "casos", cases.ambiguous_cases(classified), ["dia", "id"], touched)
    schema.write_table(reconcile.reconciliations(classified, ts), root, "reconciliacoes")
    settle_lines(read("movimentos"), read("linhas"), read("reconciliacoes"), root)
    t = F.col("tipo_match")
    counts = classified.groupBy("dia").agg(F.count_if(t == "exato").alias("casados"),
                                           F.count_if(t == "novo").alias("novos"),
                                           F.count_if(t == "ambiguo").alias("ambiguos"))
    if dias is None:
        return counts
    return spark.createDataFrame([(d,) for d in dias], "dia date").join(counts, "dia", "left").fillna(0)


def settle_lines(movements: DataFrame, lines: DataFrame, reconciliations: DataFrame, root: str) -> None:
    """Rewrite the days that have a matched line which is not paid yet."""
    paid = reconcile.apply_matches(lines, reconciliations, movements)
    behind = (lines.where("pago is null").select("id", "dia")
              .join(paid.where("pago is not null").select("id"), "id", "left_semi"))
    days = schema.days_of(behind)
    if days:
        schema.write_table(paid.where(F.col("dia").isin(days)).checkpoint(), root, "linhas",
                           mode="overwrite")


def decide(spark: SparkSession, root: str, decisoes: DataFrame) -> DataFrame:
    """Apply decisions to the stored tables; returns the rejected ones. Lines and
    reconciliations are stored before the cases that show the decision. Apart from
    finding the cases, only the days of those cases are read and written."""
    ensure_checkpoint_dir(spark)
    asked = decisoes.select(F.col("caso_id").alias("id")).distinct()
    days = schema.days_of(schema.read_table(spark, root, "casos").join(asked, "id", "left_semi"))
    tables = [schema.read_table(spark, root, t, days)
              for t in ("casos", "candidatos", "reconciliacoes", "linhas")]
    done = cases.apply_decisions(decisoes, *tables)
    changed = {name: rows.checkpoint() for name, rows in (
        ("linhas", done.linhas), ("reconciliacoes", done.reconciliacoes), ("casos", done.casos))}
    rejected = done.rejeitados.checkpoint()
    for name, rows in changed.items():
        schema.write_table(rows, root, name, mode="overwrite")
    return rejected


def record(spark: SparkSession, root: str, novas: DataFrame) -> DataFrame:
    """Store run reports ``(script, status, erro, log, duracao_segundos, ts)``; returns
    them as stored. Ids go by day, script and minute."""
    ensure_checkpoint_dir(spark)
    day = F.to_date("ts").alias("dia")
    rows = monitoring.record_runs(novas).select(
        "*", day, F.concat_ws("/", "script", F.date_format("ts", "HHmm")).alias("_onde"))
    stored = schema.read_table(spark, root, "execucoes", schema.days_of(rows)).select("dia", "id")
    written = assign_ids(rows, stored, "_onde", ["ts", "status", "erro"]).checkpoint()
    schema.write_table(written, root, "execucoes")
    return written.drop("dia", "_onde")

"""Imports into the ledger tables: whole days at a time, safe to repeat."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bankrec import schema
from bankrec.session import ensure_checkpoint_dir, stored
from bankrec.sources import plan_sheet, statements, workbook
from bankrec.sources.paths import MONTHS, PLANS, STATEMENTS, plan_month

RECENT_DAYS = 7
_IDS_PER_DAY = 1 << 40
MOVEMENTS, BALANCES, PLAN = "movimentos", "saldos", "linhas"


def assign_ids(novas: DataFrame, existentes: DataFrame, origem: str, ordem: list[str]) -> DataFrame:
    """Ids for new rows: a range per day, continued after the ids already there.
    Rows are numbered inside their file (``origem``) and files inside their day, so
    no task sees more than one file's rows or one day's files."""
    per_file = novas.groupBy("dia", origem).agg(F.count("*").alias("_n"))
    earlier = W.partitionBy("dia").orderBy(origem).rowsBetween(W.unboundedPreceding, -1)
    offset = per_file.withColumn("_antes", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    used = existentes.groupBy("dia").agg((F.max("id") + 1).alias("_inicio"))
    base = offset.join(used, "dia", "left").withColumn(
        "_base", F.coalesce("_inicio", F.unix_date("dia").cast("long") * _IDS_PER_DAY) + F.col("_antes"))
    rank = F.row_number().over(W.partitionBy("dia", origem).orderBy(*ordem)) - 1
    return (novas.join(base.select("dia", origem, "_base"), ["dia", origem])
            .withColumn("id", F.col("_base") + rank).drop("_base"))


def import_movements(root: str, celulas: DataFrame, dias: list[date] | None = None,
                     lote: int = 0, lidos: DataFrame | None = None) -> DataFrame:
    """Write the movements of whole days (``dias``, or all days of the files); a day
    with a rejected file waits. Writing a day again replaces it. ``lidos`` are the stored
    ``raw_movements`` of the cells, where they are there already. Returns the rows as written."""
    spark = celulas.sparkSession
    # read for the rejected days, too; the statements are parsed once
    lidos = stored(statements.raw_movements(celulas)) if lidos is None else lidos
    rows = statements.movements_of(lidos).where("dia is not null")
    bad = (statements.rejected(celulas, lidos).select(statements.statement_day("path").alias("dia"))
           .where("dia is not null").distinct())
    if dias is not None:
        rows = rows.where(F.col("dia").isin(dias))
    # read twice to number them
    rows = stored(rows.join(bad, "dia", "left_anti"))
    dias = schema.days_of(rows) if dias is None else dias
    others = schema.read_table(spark, root, MOVEMENTS, dias).where(F.col("lote") != lote)
    numbered = assign_ids(rows, others.select("dia", "id"), "path", ["row"])
    written = stored(numbered.withColumn("lote", F.lit(lote).cast("long")))
    schema.write_table(written, root, MOVEMENTS, mode="overwrite")
    return written


def unread_days(celulas: DataFrame) -> DataFrame:
    """Days with a statement file that cannot be read."""
    return (workbook.unreadable(celulas).select(statements.statement_day("path").alias("dia"))
            .where("dia is not null").distinct())


def import_balances(root: str, celulas: DataFrame, dias: list[date] | None = None,
                    fechos: DataFrame | None = None) -> DataFrame:
    """Append balances that are not there yet, by day and entity. A day with a file that
    cannot be read waits. ``fechos`` are the stored ``closings`` of the cells, where they are
    there already. Returns what was added."""
    spark = celulas.sparkSession
    # days are told by file, not by cell, and read twice
    fechos = stored(statements.closings(celulas)) if fechos is None else fechos
    found = statements.balances_of(fechos).where("dia is not null").join(unread_days(celulas), "dia", "left_anti")
    if dias is None:
        found = stored(found)
    dias = schema.days_of(found) if dias is None else dias
    existing = schema.read_table(spark, root, BALANCES, dias)
    new = (found.where(F.col("dia").isin(dias))
           .join(existing.select("dia", "entidade"), ["dia", "entidade"], "left_anti"))
    added = stored(assign_ids(stored(new), existing.select("dia", "id"), "entidade", ["dia"]))
    schema.write_table(added, root, BALANCES)
    return added


def refresh_balances(root: str, celulas: DataFrame, dia: date, fechos: DataFrame | None = None) -> DataFrame:
    """Replace one day's balances by what its files say now. Nothing is removed
    unless all files of the day were read. ``fechos`` are the stored ``closings`` of the cells,
    where they are there already."""
    spark = celulas.sparkSession
    fechos = stored(statements.closings(celulas)) if fechos is None else fechos
    found = stored(statements.balances_of(fechos).where(F.col("dia") == F.lit(dia))
                   .join(unread_days(celulas), "dia", "left_anti"))
    nothing = schema.read_table(spark, root, BALANCES, []).select("dia", "id")
    written = stored(assign_ids(found, nothing, "entidade", ["dia"]))
    schema.write_table(written, root, BALANCES, mode="overwrite")
    return written


def import_plan(root: str, celulas: DataFrame, dias: list[date] | None = None) -> DataFrame:
    """Write the plan lines of whole days."""
    spark = celulas.sparkSession
    rows = plan_sheet.plan_lines(celulas)
    if dias is not None:
        rows = rows.where(F.col("dia").isin(dias))
    nothing = schema.read_table(spark, root, PLAN, []).select("dia", "id")
    written = stored(assign_ids(rows, nothing, "path", ["tipo", "linha"]))
    schema.write_table(written, root, PLAN, mode="overwrite")
    return written


def plan_days(hoje: date, dias_atras: int, ficheiros: DataFrame, presentes: DataFrame) -> DataFrame:
    """What to do for each table on each of the last days: ``(dia, tabela, acao)``.

    ``ficheiros`` is ``(dia, tabela)`` with files to read, ``presentes`` is
    ``(dia, tabela)`` with rows already stored. Yesterday's balances are provisional
    and read again.
    """
    spark = ficheiros.sparkSession
    tables = F.explode(F.array(*[F.lit(t) for t in (MOVEMENTS, BALANCES, PLAN)])).alias("tabela")
    days = spark.range(dias_atras + 1).select(
        F.date_sub(F.lit(hoje), F.col("id").cast("int")).alias("dia"), tables)
    mark = lambda df, name: df.select("dia", "tabela", F.lit(True).alias(name)).distinct()
    known = (days.join(mark(ficheiros, "_f"), ["dia", "tabela"], "left")
             .join(mark(presentes, "_p"), ["dia", "tabela"], "left"))
    provisional = (F.col("tabela") == BALANCES) & (F.col("dia") == F.lit(hoje - timedelta(days=1)))
    action = (F.when(F.col("_f").isNull(), "sem ficheiro").when(F.col("_p").isNull(), "importar")
              .when(provisional, "atualizar").otherwise("presente"))
    return known.select("dia", "tabela", action.alias("acao"))


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def statement_folder(pasta: str, dia: date) -> str:
    return f"{pasta}/{STATEMENTS}/{dia:%m}_{MONTHS[dia.month - 1]}/{dia:%d-%m-%Y}"


def plan_file(pasta: str, dia: date) -> str:
    name = f"{dia:%m} - Mapa de Pagamentos  e Recebimentos de {MONTHS[dia.month - 1]}.xlsx"
    return f"{pasta}/{PLANS}/{dia:%Y}/{name}"


def _read_cells(spark: SparkSession, paths: list[str]) -> DataFrame:
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(paths)
             .select("path", "content"))
    return stored(workbook.cells(files))


def import_cells(root: str, celulas: DataFrame, planos: DataFrame | None, dias: list[date],
                 hoje: date | None = None) -> tuple[DataFrame, DataFrame]:
    """Import ``dias`` from the cells of their statements and plan workbooks, each table only
    where it has no row for the day; with ``hoje``, yesterday's balances are read again.
    Returns ``(dia, tabela, linhas)`` written and ``(dia, tabela, motivo)`` not imported."""
    spark = celulas.sparkSession
    wanted = spark.createDataFrame([(d,) for d in dias], "dia date")

    def absent(table: str) -> list[date]:
        stored = set(schema.days_of(schema.read_table(spark, root, table, dias)))
        return [d for d in dias if d not in stored]

    def count(rows: DataFrame, table: str) -> DataFrame:
        return rows.groupBy("dia").agg(F.count("*").alias("linhas")).select(
            "dia", F.lit(table).alias("tabela"), "linhas")

    lidos = stored(statements.raw_movements(celulas))
    report = count(import_movements(root, celulas, absent(MOVEMENTS), lidos=lidos), MOVEMENTS)
    yesterday = hoje - timedelta(days=1) if hoje else None
    fechos = stored(statements.closings(celulas))
    if yesterday in dias:
        report = report.unionByName(count(refresh_balances(root, celulas, yesterday, fechos), BALANCES))
    report = report.unionByName(count(import_balances(root, celulas, absent(BALANCES), fechos), BALANCES))
    file_day = statements.statement_day("path").alias("dia")
    errors = (statements.rejected(celulas, lidos).select(file_day, F.lit(MOVEMENTS).alias("tabela"), "motivo").unionByName(
        workbook.unreadable(celulas).select(file_day, F.lit(BALANCES).alias("tabela"), "motivo"))
        .join(wanted, "dia", "left_semi"))
    if planos is not None:
        report = report.unionByName(count(import_plan(root, planos, absent(PLAN)), PLAN))
        errors = errors.unionByName(plan_errors(planos, wanted))
    return report, errors


def import_days(spark: SparkSession, root: str, pasta: str, dias: list[date],
                hoje: date | None = None) -> tuple[DataFrame, DataFrame]:
    """``import_cells`` for the files of a folder. Days without a statement folder are left
    alone."""
    ensure_checkpoint_dir(spark)
    there = [d for d in dias if _exists(spark, statement_folder(pasta, d))]
    if not there:
        return (spark.createDataFrame([], "dia date, tabela string, linhas long"),
                spark.createDataFrame([], "dia date, tabela string, motivo string"))
    cells = _read_cells(spark, [statement_folder(pasta, d) for d in there])
    plans = sorted({plan_file(pasta, d) for d in there if _exists(spark, plan_file(pasta, d))})
    return import_cells(root, cells, _read_cells(spark, plans) if plans else None, there, hoje)


def plan_errors(celulas: DataFrame, dias: DataFrame) -> DataFrame:
    """``(dia, tabela, motivo)`` for each of ``dias`` whose plan workbook cannot be read, or
    whose sheet is missing or has no totals."""
    months = dias.select("dia", F.trunc("dia", "month").alias("_mes"))
    unread = (workbook.unreadable(celulas).withColumn("_mes", plan_month("path")).join(months, "_mes")
              .select("dia", "motivo"))
    expected = (celulas.where("erro is null").select("path").distinct()
                .withColumn("_mes", plan_month("path")).join(months, "_mes").select("path", "dia"))
    rejected = plan_sheet.rejected(celulas, expected).join(dias, "dia", "left_semi").select("dia", "motivo")
    return unread.unionByName(rejected).select("dia", F.lit(PLAN).alias("tabela"), "motivo")


def import_recent(spark: SparkSession, root: str, pasta: str, hoje: date,
                  dias_atras: int = RECENT_DAYS) -> tuple[DataFrame, DataFrame]:
    days = [hoje - timedelta(days=i) for i in range(dias_atras, -1, -1)]
    return import_days(spark, root, pasta, days, hoje)


def import_day(spark: SparkSession, root: str, pasta: str, dia: date) -> tuple[DataFrame, DataFrame]:
    return import_days(spark, root, pasta, [dia])

"""Queries over stored tables: imports, refreshes, recorded runs and the stream, each into
tables of its own below the shared folder."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bankrec import schema
from bankrec.operators import ingest, runs
from bankrec.plans import ledger, workbooks
from bankrec.session import shared_folder, stored
from bankrec.sources import logs, workbook
from bankrec.sources.paths import statement_day
from bankrec.streaming import imports


def _ledger(spark: SparkSession) -> str:
    root = shared_folder(spark)
    schema.create_tables(spark, root)
    return root


def _files(spark: SparkSession, sf: str, factor: int = 1) -> DataFrame:
    """Statements of all companies and days, with closing balances times ``factor``."""
    closing = ledger.balances(spark, sf).withColumn(
        "saldo_contabilistico", (F.col("saldo_contabilistico") * factor).cast(schema.MONEY))
    return workbooks.statement_files(ledger.flows(spark, sf), closing, "raiz")


def _cells(files: DataFrame) -> DataFrame:
    return stored(workbook.cells(files))


def _days(spark: SparkSession, sf: str) -> list[date]:
    return sorted(schema.days_of(ledger.flows(spark, sf)))


def _text(day: str = "dia") -> Column:
    return F.col(day).cast("string").alias("dia")


def import_day(spark, sf):
    """Of all statements, the middle day alone is stored."""
    root, days = _ledger(spark), _days(spark, sf)
    middle = days[0] + timedelta(days=(days[-1] - days[0]).days // 2)
    ingest.import_cells(root, _cells(_files(spark, sf)), None, [middle])
    read = lambda name, total: schema.read_table(spark, root, name).groupBy("dia").agg(
        F.count("*").alias("n"), F.sum(total).cast("double").alias("total")).select(
        _text(), F.lit(name).alias("tabela"), "n", "total")
    return read("movimentos", "valor").unionByName(read("saldos", "saldo_contabilistico"))


def import_recent(spark, sf):
    """What two runs over all days wrote: the second reads yesterday's balances again only."""
    root, days = _ledger(spark), _days(spark, sf)
    cells, today = _cells(_files(spark, sf)), days[-1] + timedelta(days=1)
    reports = [ingest.import_cells(root, cells, None, days, today)[0].select(
        F.lit(run).cast("bigint").alias("volta"), _text(), "tabela", "linhas") for run in (1, 2)]
    return reports[0].unionByName(reports[1])


def import_errors(spark, sf):
    """One company's statements of even days cannot be read, so these days wait."""
    root, days = _ledger(spark), _days(spark, sf)
    broken = F.col("path").endswith("_Conta 7, SA.xlsx") & (F.dayofmonth(statement_day("path")) % 2 == 0)
    files = _files(spark, sf).withColumn("content", F.when(broken, F.encode(F.lit("nada"), "UTF-8")).otherwise(F.col("content")))
    _, errors = ingest.import_cells(root, _cells(files), None, days)
    bad = errors.groupBy("dia", "tabela").agg(F.count("*").alias("erros"))
    written = [schema.read_table(spark, root, t).groupBy("dia").agg(F.count("*").alias("linhas")).withColumn("tabela", F.lit(t))
               for t in ("movimentos", "saldos")]
    both = written[0].unionByName(written[1]).join(bad, ["dia", "tabela"], "full_outer")
    return both.select(_text(), "tabela", F.coalesce("erros", F.lit(0)).alias("erros"), F.coalesce("linhas", F.lit(0)).alias("linhas"))


def balances_refreshed(spark, sf):
    """Stored balances after the last day's files came again with other balances."""
    root, days = _ledger(spark), _days(spark, sf)
    ingest.import_balances(root, _cells(_files(spark, sf)))
    ingest.refresh_balances(root, _cells(_files(spark, sf, factor=2)), days[-1])
    return schema.read_table(spark, root, "saldos").select(
        _text(), "entidade", F.col("saldo_contabilistico").cast("double").alias("saldo_contabilistico"))


def runs_recorded(spark, sf):
    """Runs stored twice get ids of their own."""
    root = _ledger(spark)
    new = ledger.executions(spark, sf).drop("id")
    for _ in range(2):
        runs.record(spark, root, new)
    return schema.read_table(spark, root, "execucoes").groupBy("dia", "script").agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("ids")).select(_text(), "script", "n", "ids")


def stream_import(spark, sf):
    """Statements that arrive in two parts, followed by a stream that is started three times."""
    root, landing, point = _ledger(spark), shared_folder(spark), shared_folder(spark)
    # a checkpoint would render them twice
    files = stored(_files(spark, sf))
    for part in (0, 1, None):
        if part is not None:
            files.where(F.crc32("path") % 2 == part).write.mode("append").parquet(landing)
        arriving = spark.readStream.schema("path string, content binary").parquet(landing)
        query = imports.follow(arriving, root, point)
        query.awaitTermination()
    return schema.read_table(spark, root, "movimentos").groupBy("dia").agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.sum("valor").cast("double").alias("total")).select(
        _text(), "n", "ids", "total")


def archived_logs(spark, sf):
    """Lines per day of the compressed archive."""
    out = shared_folder(spark)
    logs.archive(ledger.log_lines(spark, sf), out)
    return spark.read.schema("value string, dia string").text(out).groupBy("dia").agg(F.count("*").alias("n"))


QUERIES = {q.__name__: q for q in (import_day, import_recent, import_errors, balances_refreshed, runs_recorded, stream_import,
                                   archived_logs)}

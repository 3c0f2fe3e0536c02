"""The ledger tables: schemas, creation, reading and writing."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_LONG, _INT, _TEXT = T.LongType(), T.IntegerType(), T.StringType()
_DAY, _TS, _REAL = T.DateType(), T.TimestampType(), T.DoubleType()

MOVIMENTOS = _struct(id=_LONG, dia=_DAY, empresa=_TEXT, descricao=_TEXT, valor=MONEY,
                     ficheiro_origem=_TEXT, chave=_TEXT)
LINHAS = _struct(id=_LONG, dia=_DAY, tipo=_TEXT, linha=_INT, empresa=_TEXT, previsto=MONEY,
                 pago=MONEY, imputacao=_TEXT, chave=_TEXT)
RECONCILIACOES = _struct(movimento_id=_LONG, linha_id=_LONG, tipo_match=_TEXT, ts=_TS, dia=_DAY)
CASOS = _struct(id=_LONG, movimento_id=_LONG, dia=_DAY, empresa=_TEXT, valor=MONEY, grupo=_LONG,
                n_candidatos=_LONG, resolvido_por=_TEXT, resolucao=_TEXT,
                resolucao_sugerida=_TEXT, justificacao_sugerida=_TEXT)
CANDIDATOS = _struct(dia=_DAY, grupo=_LONG, linha_id=_LONG, n_candidatos=_LONG)
DECISOES = _struct(caso_id=_LONG, linha_id=_LONG, resolvido_por=_TEXT, ts=_TS)
SALDOS = _struct(id=_LONG, dia=_DAY, entidade=_TEXT, saldo_contabilistico=MONEY,
                 saldo_disponivel=MONEY, chave=_TEXT)
EXECUCOES = _struct(id=_LONG, script=_TEXT, status=_TEXT, erro=_TEXT, log=T.ArrayType(_TEXT),
                    duracao_segundos=_REAL, ts=_TS)
CELULAS = _struct(path=_TEXT, sheet=_TEXT, first_sheet=T.BooleanType(), row=_INT, col=_TEXT,
                  kind=_TEXT, text=_TEXT, number=_REAL, formula=_TEXT)
REJEITADOS = _struct(path=_TEXT, motivo=_TEXT)

# table name -> (schema, partition columns)
TABLES = {
    "movimentos": (T.StructType(MOVIMENTOS.fields + [T.StructField("lote", _LONG, True)]),
                   ["dia", "lote"]),
    "linhas": (LINHAS, ["dia"]),
    "reconciliacoes": (RECONCILIACOES, ["dia"]),
    "casos": (CASOS, ["dia"]),
    "candidatos": (CANDIDATOS, ["dia"]),
    "saldos": (SALDOS, ["dia"]),
    "execucoes": (T.StructType(EXECUCOES.fields + [T.StructField("dia", _DAY, True)]), ["dia"]),
    "rejeitados": (T.StructType(REJEITADOS.fields + [T.StructField("lote", _LONG, True)]), ["lote"]),
}


def table_path(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def write_table(df: DataFrame, root: str, name: str, mode: str = "append") -> None:
    """Write rows in the table's column order. ``overwrite`` replaces only the
    partitions that ``df`` holds."""
    schema, parts = TABLES[name]
    rows = df.select([F.col(f.name).cast(f.dataType) for f in schema.fields])
    if parts:      # else every task would write a file into every partition
        rows = rows.hint("rebalance", *parts)
    writer = rows.write.mode(mode)
    if parts:
        writer = writer.partitionBy(*parts).option("partitionOverwriteMode", "dynamic")
    writer.parquet(table_path(root, name))


def create_tables(spark: SparkSession, root: str) -> None:
    for name, (schema, _) in TABLES.items():
        write_table(spark.createDataFrame([], schema), root, name)


def read_table(spark: SparkSession, root: str, name: str,
               dias: list[date] | None = None) -> DataFrame:
    """A table, or the partitions of some days only."""
    schema, _ = TABLES[name]
    rows = spark.read.schema(schema).parquet(table_path(root, name))
    return rows if dias is None else rows.where(F.col("dia").isin(dias))


def days_of(df: DataFrame) -> list[date]:
    """The days in a frame; a calendar's worth of values at most."""
    return [r["dia"] for r in df.where("dia is not null").select("dia").distinct().collect()]

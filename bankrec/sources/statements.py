"""Bank statements: movements and closing balances, from workbook cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bankrec.functions.text import company_key, strip
from bankrec.functions.values import money_lenient, money_or_null
from bankrec.sources.paths import entity, file_name, statement_day

HEADER_ROWS = 20
BALANCE_ROWS = 11
_MONEY = "decimal(18,2)"


def _first_sheet(celulas: DataFrame, columns: list[str]) -> DataFrame:
    return celulas.where(F.col("first_sheet") & F.col("col").isin(columns) & F.col("erro").isNull())


def shown() -> Column:
    """A cell as text; whole numbers without a decimal point."""
    number = F.col("number")
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.coalesce("text", F.when(whole, number.cast("long").cast("string"))
                      .otherwise(number.cast("string")))


def _money(strict: bool) -> Column:
    """Text is parsed; a numeric cell is taken as it is."""
    parsed = money_or_null("text") if strict else money_lenient("text")
    return F.when(F.col("kind") == "number", F.col("number").cast(_MONEY)).otherwise(parsed)


def raw_movements(celulas: DataFrame) -> DataFrame:
    """``(path, row, descricao, valor, montante, mau)`` below the header and above the end
    of each statement. ``valor`` is null where ``montante`` is not an amount, and ``mau`` tells
    whether the file has such a row.

    Cells are brought together by file once; grouping by row, the header, the end and the
    mark of a file all follow from that order. Rows missing from the file count as empty.
    """
    at = lambda c, what: F.max(F.when(F.col("col") == c, what))
    rows = (_first_sheet(celulas, ["A", "C", "D"]).where("path is not null").repartition("path")
            .groupBy("path", "row")
            .agg(at("A", shown()).alias("a"), at("C", shown()).alias("c"),
                 at("D", shown()).alias("montante"), at("D", _money(True)).alias("valor")))
    by_row = W.partitionBy("path").orderBy("row")
    so_far = by_row.rowsBetween(W.unboundedPreceding, 0)
    is_header = (F.col("row") <= HEADER_ROWS) & strip("a").startswith("Data mov")
    # rows come in order, so the first header so far is the first of the file
    placed = rows.withColumns({"_cabecalho": F.min(F.when(is_header, F.col("row"))).over(so_far),
                               "_anterior": F.lag("row").over(by_row)})
    # the first row that is empty, or missing after a row that is there
    filled = F.col("a").isNotNull() | F.col("c").isNotNull()
    broken = F.when(~filled, F.col("row")).when(F.col("row") > F.col("_anterior") + 1, F.col("_anterior") + 1)
    end = F.min("_quebra").over(so_far)
    within = (placed.where(F.col("row") > F.col("_cabecalho")).withColumn("_quebra", broken).withColumn("_fim", end)
              .where("_fim is null and montante is not null"))
    whole = by_row.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return within.select("path", "row", F.coalesce(strip("c"), F.lit("")).alias("descricao"), "valor", "montante",
                         F.max(F.col("valor").isNull()).over(whole).alias("mau"))


def movements_of(raw: DataFrame) -> DataFrame:
    """The movements among ``raw_movements``, with day, company and file of origin, without ids."""
    return (raw.where(~F.col("mau"))
            .withColumn("dia", statement_day("path")).withColumn("empresa", entity("path"))
            .withColumn("ficheiro_origem", file_name("path"))
            .withColumn("chave", company_key("empresa"))
            .select("path", "row", "dia", "empresa", "descricao", "valor", "ficheiro_origem", "chave"))


def statement_movements(celulas: DataFrame) -> DataFrame:
    """Movements with day, company and file of origin, without ids. A file with an
    unreadable amount gives no movements; see ``rejected``."""
    return movements_of(raw_movements(celulas))


def rejected(celulas: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """One row per statement that was not imported, with the reason; ``raw`` is the
    ``raw_movements`` of the cells, where they are there already."""
    raw = raw_movements(celulas) if raw is None else raw
    amounts = raw.where("valor is null").select(
        "path", F.format_string("montante inválido na linha %d: %s", F.col("row"), F.col("montante"))
        .alias("motivo"))
    unreadable = celulas.where("erro is not null").select("path", F.col("erro").alias("motivo"))
    return amounts.unionByName(unreadable)


def closings(celulas: DataFrame) -> DataFrame:
    """``(path, saldo_contabilistico, saldo_disponivel)``: a row for each file that can be read,
    whatever it holds; the last matching label counts."""
    top = _first_sheet(celulas, ["A", "B"]).where(F.col("row") <= BALANCE_ROWS)
    at = lambda c, what: F.max(F.when(F.col("col") == c, what))
    # a file's cells meet once, in the order both steps need
    rows = top.repartition("path").groupBy("path", "row").agg(at("A", shown()).alias("rotulo"), at("B", _money(False)).alias("valor"))
    named = lambda t: F.max_by(F.struct("valor"), F.when(F.col("rotulo").contains(t), F.col("row")))
    files = celulas.where("erro is null").select("path").distinct()
    return rows.unionByName(files, allowMissingColumns=True).groupBy("path").agg(
        named("Saldo contabilístico").alias("c"), named("Saldo disponível").alias("d")).select(
        "path", F.col("c.valor").alias("saldo_contabilistico"), F.col("d.valor").alias("saldo_disponivel"))


def balances_of(fechos: DataFrame) -> DataFrame:
    """The balances of ``closings`` by day and entity: the last file name of an entity counts."""
    last = F.max_by(F.struct("saldo_contabilistico", "saldo_disponivel"), "path")
    return (fechos.select("path", statement_day("path").alias("dia"), entity("path").alias("entidade"),
                          "saldo_contabilistico", "saldo_disponivel")
            .groupBy("dia", "entidade").agg(last.alias("s")).select("dia", "entidade", "s.*")
            .withColumn("chave", company_key("entidade")))


def statement_balances(celulas: DataFrame) -> DataFrame:
    """``(dia, entidade, saldo_contabilistico, saldo_disponivel, chave)``: the last
    matching label of a file counts, and the last file name of an entity."""
    return balances_of(closings(celulas))

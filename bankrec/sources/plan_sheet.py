"""The payments and receipts plan: lines of each day's sheet, from workbook cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankrec.functions.text import company_key, strip
from bankrec.sources.paths import plan_month
from bankrec.sources.statements import shown

FIRST_ROW = 5
# The two column blocks of a day's sheet.
BLOCKS = (
    ("recebimento", 1, "C", "D", "E", "F"),
    ("pagamento", -1, "I", "J", "K", "L"),
)
_MONEY = "decimal(18,2)"


def day_sheets(celulas: DataFrame) -> DataFrame:
    """Cells of sheets named with a two-digit day of the workbook's month."""
    day = F.when(F.col("sheet").rlike(r"^\d{2}$"), F.col("sheet").cast("int"))
    month = plan_month("path")
    dia = F.to_date(F.try_make_timestamp(F.year(month), F.month(month), day, F.lit(0), F.lit(0), F.lit(0)))
    return celulas.where("erro is null").withColumn("dia", dia).where("dia is not null")


def totals_rows(folhas: DataFrame) -> DataFrame:
    """Row of the first ``=SUM(`` formula of each day's sheet."""
    return (folhas.where((F.col("row") >= FIRST_ROW) & F.col("formula").startswith("=SUM("))
            .groupBy("path", "dia").agg(F.min("row").alias("_totais")))


def plan_lines(celulas: DataFrame) -> DataFrame:
    """Planned lines with signed amounts, without ids. An amount that is not a plain
    number, a formula included, is null."""
    sheets = day_sheets(celulas)
    wanted = sorted({c for block in BLOCKS for c in block[2:]})
    cells = (sheets.where(F.col("col").isin(wanted) & (F.col("row") >= FIRST_ROW))
             .join(totals_rows(sheets), ["path", "dia"]).where("row < _totais"))
    text = F.coalesce("formula", shown())
    number = F.when((F.col("kind") == "number") & F.col("formula").isNull(), F.col("number").cast(_MONEY))
    blocks = F.array(*[F.struct(F.lit(t).alias("tipo"), F.lit(s).alias("sinal"),
                                F.lit(p).alias("p"), F.lit(r).alias("r"), F.lit(e).alias("e"),
                                F.lit(i).alias("i")) for t, s, p, r, e, i in BLOCKS])
    # each cell belongs to one block
    own = cells.withColumn("b", F.explode(F.filter(
        blocks, lambda b: F.col("col").isin(b["p"], b["r"], b["e"], b["i"]))))
    at = lambda f, what: F.max(F.when(F.col("col") == F.col(f"b.{f}"), what))
    rows = own.groupBy("path", "dia", "row", F.col("b.tipo").alias("tipo"), F.col("b.sinal").alias("sinal")).agg(
        at("e", text).alias("empresa"), at("p", number).alias("previsto"),
        at("r", number).alias("pago"), at("i", text).alias("imputacao"))
    signed = lambda c: (F.col(c) * F.col("sinal")).cast(_MONEY).alias(c)
    return (rows.where("empresa is not null and empresa <> ''")
            .select("path", "dia", "tipo", F.col("row").alias("linha"), strip("empresa").alias("empresa"),
                    signed("previsto"), signed("pago"),
                    F.when(F.col("imputacao") != "", strip("imputacao")).alias("imputacao"))
            .withColumn("chave", company_key("empresa")))


def rejected(celulas: DataFrame, dias: DataFrame | None = None) -> DataFrame:
    """Day sheets without a totals row and, given ``dias`` ``(path, dia)``, days whose
    sheet is missing."""
    sheets = day_sheets(celulas).select("path", "dia").distinct()
    no_totals = (sheets.join(totals_rows(day_sheets(celulas)), ["path", "dia"], "left_anti")
                 .select("path", "dia", F.lit("linha de totais não encontrada").alias("motivo")))
    if dias is None:
        return no_totals
    missing = (dias.select("path", "dia").join(sheets, ["path", "dia"], "left_anti")
               .select("path", "dia", F.lit("folha do dia não existe").alias("motivo")))
    return no_totals.unionByName(missing)

"""What file paths say: company, day, and where a day's files are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bankrec.functions.text import strip

# Month names in folder and file names.
MONTHS = ("Janeiro", "Fevereiro", "Março", "Abril", "Maio", "Junho", "Julho", "Agosto",
          "Setembro", "Outubro", "Novembro", "Dezembro")
STATEMENTS = "FINANCEIRO/03 - Extratos Bancários/Movimentos Diários/CGD"
PLANS = "CONTABILIDADE/13- Mapa de Pagamentos e Recebimentos"


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def file_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def entity(path: Column | str) -> Column:
    """File name without extension and leading date."""
    stem = F.regexp_replace(file_name(path), r"\.[^.]*$", "")
    return strip(F.regexp_replace(stem, r"^\d{2}-\d{2}-\d{4}_", ""))


def statement_day(path: Column | str) -> Column:
    """Day of a statement, from its ``dd-mm-yyyy`` folder; null elsewhere."""
    # the folder before the last name, which must not be empty
    folder = F.regexp_extract(F.substring_index(F.concat(F.lit("\x01"), _col(path)), "/", -2), r"^(\d{2}-\d{2}-\d{4})/[^/]", 1)
    part = lambda at, n: F.substring(folder, at, n).try_cast("int")
    return F.to_date(F.try_make_timestamp(part(7, 4), part(4, 2), part(1, 2), F.lit(0), F.lit(0), F.lit(0)))


def plan_month(path: Column | str) -> Column:
    """First day of the month a plan workbook is for, from ``.../yyyy/mm - ...``."""
    part = lambda g: F.regexp_extract(_col(path), r"/(\d{4})/(\d{2}) - [^/]+$", g).try_cast("int")
    return F.to_date(F.try_make_timestamp(part(1), part(2), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))


def _month_name(dia: Column) -> Column:
    return F.array(*[F.lit(m) for m in MONTHS])[F.month(dia) - 1]


def statement_folder(root: str, dia: Column | str) -> Column:
    dia = _col(dia)
    return F.concat(F.lit(f"{root}/{STATEMENTS}/"), F.date_format(dia, "MM"), F.lit("_"),
                    _month_name(dia), F.lit("/"), F.date_format(dia, "dd-MM-yyyy"))


def plan_path(root: str, dia: Column | str) -> Column:
    dia = _col(dia)
    return F.concat(F.lit(f"{root}/{PLANS}/"), F.date_format(dia, "yyyy"), F.lit("/"),
                    F.date_format(dia, "MM"), F.lit(" - Mapa de Pagamentos  e Recebimentos de "),
                    _month_name(dia), F.lit(".xlsx"))

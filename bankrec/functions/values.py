"""Money, calendar, vector and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bankrec.functions.text import strip


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _plain_number(col: Column) -> Column:
    return F.replace(F.replace(strip(col), F.lit("."), F.lit("")), F.lit(","), F.lit("."))


def money_strict(col: Column | str) -> Column:
    """``1.234,56`` to money; anything else fails the job (ANSI mode)."""
    return _plain_number(_col(col)).cast("decimal(18,2)")


def money_or_null(col: Column | str) -> Column:
    """``1.234,56`` to money; anything else is null."""
    return _plain_number(_col(col)).try_cast("decimal(18,2)")


def money_lenient(col: Column | str) -> Column:
    """``1.234,56 EUR`` to money; anything else is null."""
    return money_or_null(F.replace(_col(col), F.lit("EUR"), F.lit("")))


def receipt(col: Column | str) -> Column:
    """Sum of receipts; zero counts as one."""
    col = _col(col)
    return F.coalesce(F.sum(F.when(col >= 0, col)), F.lit(0))


def payment(col: Column | str) -> Column:
    """Sum of payments in absolute value."""
    col = _col(col)
    return F.coalesce(F.sum(F.when(col < 0, -col)), F.lit(0))


def calendar(dia: Column | str) -> dict[str, Column]:
    """Weekday with Monday = 0, day of month, weekend flag."""
    dia = _col(dia)
    return {"dia_semana": F.weekday(dia), "dia_mes": F.dayofmonth(dia),
            "fim_de_semana": (F.weekday(dia) >= 5).cast("int")}


def iso_utc(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def order_of(number: str, id: str = "id") -> str:
    """(number, id) as one fixed-width value that sorts the same way, as SQL. Spark
    keeps it in a hash aggregate, where a struct would need every row sorted."""
    return f"(cast({number} as decimal(20,0)) * 20000000000000000000BD + cast({id} as decimal(19,0)))"


def dot(a: Column | str, b: Column | str) -> Column:
    product = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity, 0 when either norm is 0."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


# Labels shown to people.
STATUS_LABELS = {"ok": "✅ OK", "erro": "❌ Erro", "warning": "⚠️ Aviso"}
SERIES_LABELS = {
    "recebimentos": "Recebimentos",
    "pagamentos": "Pagamentos",
    "saldo_contabilistico": "Saldo contabilístico",
    "saldo_disponivel": "Saldo disponível",
}
STATE_LABELS = {
    "exato": "Casados",
    "ambiguo": "Ambíguos",
    "novo": "Novos",
    "por_processar": "Por processar",
}
MODEL_LABELS = {
    "regressao_linear": "Regressão linear",
    "media_movel": "Média móvel",
    "suavizacao_exponencial": "Suavização exponencial",
    "arima": "ARIMA",
    "markov_switching": "Markov-switching",
    "gradient_boosting": "Gradient Boosting",
}
FEATURE_LABELS = {
    "dia_semana": "Dia da semana",
    "dia_mes": "Dia do mês",
    "fim_de_semana": "Fim de semana",
    "lag_1": "Valor de ontem",
    "lag_2": "Valor de há 2 dias",
    "lag_3": "Valor de há 3 dias",
    "media_movel_5": "Média móvel (5 dias)",
}


def label(col: Column | str, labels: dict[str, str]) -> Column:
    """Display name, or the value itself when it has none."""
    col = _col(col)
    pairs = ";".join(f"{k}={v}" for k, v in labels.items())
    table = F.str_to_map(F.lit(pairs), F.lit(";"), F.lit("="))
    return F.coalesce(F.try_element_at(table, col), col)

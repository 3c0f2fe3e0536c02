"""Forecasts and hold-out evaluation of every series at once.

The linear trend and the moving average come from sums; the recursive models are folds over
a series' values, a batch of series at a time, see ``recursions``. Spark gathers each series into one row: a daily series
has at most one value per calendar day, so a row stays small however many movements are
behind it. History, forecasts and held-out values travel in that row, so nothing is joined
back but the boosted values, which one model gives for all series, see ``boosting``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankrec.functions.text import key_of
from bankrec.functions.values import MODEL_LABELS, label
from bankrec.operators import boosting as b
from bankrec.operators import recursions as rec
from bankrec.operators import series as s
from bankrec.session import deal_out, stored

MIN_POINTS = 5
_BLOCK = 1024     # days whose sums are one row
LINEAR, AVERAGE = "regressao_linear", "media_movel"
MODEL_ORDER = [LINEAR, AVERAGE, rec.HOLT, rec.ARIMA, rec.MARKOV, b.BOOSTING]


def too_short(series: DataFrame, minimum: int = MIN_POINTS) -> DataFrame:
    """Series without a forecast, with the reason."""
    short = series.groupBy("serie").agg(F.count("*").alias("n")).where(F.col("n") < minimum)
    return short.withColumn("motivo", F.format_string("só há %d pontos e são precisos %d",
                                                      F.col("n"), F.lit(minimum)))


def trends(series: DataFrame) -> DataFrame:
    """What the simple models need of each series: points, last day, sums, and the last
    values. Sums of blocks of days are merged, so no series has to fit a row or a task."""
    place = F.struct("t", "valor")
    blocks = series.groupBy("serie", F.floor(F.col("t") / _BLOCK).alias("_bloco")).agg(
        F.count("*").alias("n"), F.max("dia").alias("ultimo"), F.sum("valor").alias("y"),
        F.sum(F.col("t") * F.col("valor")).alias("ty"),
        _last(F.collect_list(place)).alias("fim"))
    merged = blocks.groupBy("serie").agg(
        F.sum("n").cast("double").alias("n"), F.max("ultimo").alias("ultimo"), F.sum("y").alias("y"), F.sum("ty").alias("ty"),
        _last(F.flatten(F.collect_list("fim"))).alias("fim"))
    return merged.withColumn("m", F.expr("(ty - (n - 1) / 2 * y) / (n * (n * n - 1) / 12)"))


def _last(points: Column) -> Column:
    """The last points, the latest first; all of them where there are few."""
    return F.slice(F.sort_array(points, asc=False), 1, s.MEAN_WINDOW)


def gather(series: DataFrame) -> DataFrame:
    """One row per series: first and last day, and the values in order."""
    return (series.groupBy("serie")
            .agg(F.array_sort(F.collect_list(F.struct("t", "valor"))).alias("p"),
                 F.expr("min(unix_date(dia)) as primeiro"), F.expr("max(dia) as ultimo"))
            .selectExpr("serie", "primeiro", "ultimo", "p.valor as valores",
                        "cast(null as array<double>) as real"))


def hold_out(linhas: DataFrame, k: int) -> DataFrame:
    """Gathered series cut into training values and the last ``k``, where long enough."""
    return linhas.where(f"size(valores) >= {MIN_POINTS + k}").selectExpr(
        "serie", "primeiro", "ultimo", f"slice(valores, 1, size(valores) - {k}) as valores",
        f"slice(valores, -{k}, {k}) as real")


def fitted(linhas: DataFrame, h: int, names: list[str]) -> DataFrame:
    """One row per gathered series and model: ``serie, ultimo, real, modelo, falha, valores``,
    with the next ``h`` values or the reason there are none. Folds are heavy for their few
    bytes, so series are dealt out to all tasks."""
    if not {*names} <= {LINEAR, AVERAGE}:
        linhas = deal_out(linhas, "serie")
    told = linhas.selectExpr("serie", "ultimo", "real", *[f"{_MODELS[m]('valores', h)} as _{m}" for m in names])
    each = ", ".join(f"struct('{m}' as modelo, _{m} as m)" for m in names)
    # a generator's columns are values: what is read from them is not computed again
    return told.selectExpr("serie", "ultimo", "real", f"inline(array({each}))").selectExpr(
        "serie", "ultimo", "real", "modelo", "m.falha", "m.valores")


def boosted(linhas: DataFrame, h: int) -> DataFrame:
    """The same rows for the boosted model, which is fitted to all series together."""
    rows = b.scaled(linhas)
    model = b.fit(rows)
    ahead = linhas.selectExpr("serie", "cast(null as array<double>) as _b").limit(0) if model is None else (
        b.ahead(rows, model, h).withColumnRenamed("valores", "_b"))
    return linhas.join(ahead, "serie", "left").select(
        "serie", "ultimo", "real", F.lit(b.BOOSTING).alias("modelo"),
        F.when(F.col("_b").isNull(), b.failure()).alias("falha"), F.col("_b").alias("valores"))


def _trend(values: str, h: int) -> str:
    """Least-squares trend on the position, from two sums."""
    n = f"cast(size({values}) as double)"
    sums = rec.let(f"struct({n} as n, aggregate({values}, 0D, (a, x) -> a + x) as y, "
                   f"aggregate(transform({values}, (x, i) -> x * i), 0D, (a, x) -> a + x) as ty)", "s",
                   "struct(s.n as n, s.y as y, (s.ty - (s.n - 1) / 2 * s.y) / (s.n * (s.n * s.n - 1) / 12) as m)")
    return _given(rec.let(sums, "u", f"transform(sequence(1, {h}), i -> u.y / u.n + u.m * ((u.n - 1) / 2 + i))"))


def _mean(values: str, h: int) -> str:
    """Mean of the last values, repeated."""
    last = f"slice({values}, -least(size({values}), {s.MEAN_WINDOW}), {s.MEAN_WINDOW})"
    return _given(f"array_repeat(aggregate({last}, 0D, (a, x) -> a + x) / size({last}), {h})")


def _given(values: str) -> str:
    return f"struct(cast(null as string) as falha, {values} as valores)"


_MODELS = {LINEAR: _trend, AVERAGE: _mean, rec.HOLT: rec.holt, rec.ARIMA: rec.arima, rec.MARKOV: rec.markov}


def _scored(rows: DataFrame, h: int, boosting: bool) -> DataFrame:
    if boosting:       # the boosted model reads the series several times
        rows = stored(deal_out(rows, "serie"))
    done = fitted(rows, h, [*_MODELS])
    return done.unionByName(boosted(rows, h)) if boosting else done


def _long(scored: DataFrame) -> DataFrame:
    return (scored.where("falha is null").selectExpr("serie", "modelo", "ultimo", "posexplode(valores) as (_i, valor)")
            .selectExpr("serie", "modelo", "date_add(ultimo, _i + 1) as dia", "valor"))


def _usable(series: DataFrame) -> DataFrame:
    return gather(series).where(f"size(valores) >= {MIN_POINTS}")


def forecast(series: DataFrame, h: int = 7, boosting: bool = False) -> DataFrame:
    """Forecasts of all models, long form ``(serie, modelo, dia, valor)``. Series
    under the minimum and models that fail are left out."""
    return _long(_scored(_usable(series), h, boosting))


def forecast_with(series: DataFrame, modelo: str, h: int = 7) -> DataFrame:
    """Forecasts of one model, long form."""
    rows = _usable(series)
    return _long(boosted(rows, h) if modelo == b.BOOSTING else fitted(rows, h, [modelo]))


def forecast_simple(series: DataFrame, h: int = 7) -> DataFrame:
    """The linear trend and the moving average, long form; series under the minimum are left
    out. One pass over the series, without a join."""
    mean = "aggregate(fim, 0D, (a, x) -> a + x.valor) / size(fim)"
    rows = trends(series).where(f"n >= {MIN_POINTS}").selectExpr("serie", "ultimo", "y / n as centro", "m", "(n - 1) / 2 as meio",
                                                                 f"{mean} as media", f"explode(sequence(1, {h})) as passo")
    return rows.selectExpr("serie", "date_add(ultimo, passo) as dia",
                           f"stack(2, '{LINEAR}', centro + m * (meio + passo), '{AVERAGE}', media) as (modelo, valor)").select(
        "serie", "modelo", "dia", "valor")


def _balance_series(saldos: DataFrame, empresa: str | None) -> DataFrame:
    rows = saldos if empresa is None else saldos.where(F.col("chave") == key_of(empresa))
    return s.balance_series(rows)


def _net_series(movimentos: DataFrame, empresa: str | None) -> DataFrame:
    """All companies and the portfolio, or one company."""
    if empresa is None:
        return s.net_series(s.cashflow_series(movimentos))
    rows = movimentos.where(F.col("chave") == key_of(empresa))
    return s.net_series(s.cashflow_series(rows)).where(F.col("serie") != s.PORTFOLIO)


def balance(saldos: DataFrame, h: int = 7, empresa: str | None = None) -> DataFrame:
    """Forecast of the ledger balance, for every company or for one."""
    return forecast(_balance_series(saldos, empresa), h)


def cashflow(movimentos: DataFrame, h: int = 7, empresa: str | None = None) -> DataFrame:
    """Forecast of the daily net flow, boosting included."""
    return forecast(_net_series(movimentos, empresa), h, boosting=True)


def evaluate_balance(saldos: DataFrame, k: int = 5, empresa: str | None = None) -> DataFrame:
    return backtest(_balance_series(saldos, empresa), k)


def evaluate_cashflow(movimentos: DataFrame, k: int = 5, empresa: str | None = None) -> DataFrame:
    return backtest(_net_series(movimentos, empresa), k, boosting=True)


def feature_importance(series: DataFrame) -> DataFrame:
    """Importance of each boosting feature over all series; sums to 1. No rows where no
    series is long enough."""
    rows = b.scaled(gather(series))
    model = b.fit(rows)
    if model is None:
        return series.sparkSession.createDataFrame([], "feature string, importancia double, nome string")
    return b.importance(model, rows)


def backtest(series: DataFrame, k: int = 5, boosting: bool = False,
             only_simple: bool = False) -> DataFrame:
    """RMSE of each model on the last ``k`` values, fitted on the rest:
    ``(serie, modelo, rmse, falha)``."""
    rows = hold_out(gather(series), k)
    scored = fitted(rows, k, [LINEAR, AVERAGE]) if only_simple else _scored(rows, k, boosting)
    squares = "zip_with(real, valores, (x, y) -> (x - y) * (x - y))"
    return scored.selectExpr(
        "serie", "modelo", f"sqrt(aggregate({squares}, 0D, (a, x) -> a + x) / {k}) as rmse", "falha")


def model_order() -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in MODEL_ORDER]), F.col("modelo"))


def best_model(scores: DataFrame) -> DataFrame:
    """Lowest RMSE per series; on ties the first in model order, boosting last."""
    order = model_order()
    return (scores.where("rmse is not null").groupBy("serie")
            .agg(F.min_by("modelo", F.struct("rmse", order)).alias("melhor_modelo"),
                 F.min("rmse").alias("rmse")))


def rmse_table(scores: DataFrame, serie: str) -> DataFrame:
    return (scores.where((F.col("serie") == serie) & F.col("rmse").isNotNull())
            .select(label("modelo", MODEL_LABELS).alias("modelo"), F.col("rmse").alias("rmse_eur"))
            .orderBy("rmse_eur"))


def chart_series(series: DataFrame, previsto: DataFrame) -> DataFrame:
    """History and forecasts in one long table, tagged by line type."""
    history = series.select("serie", "dia", "valor", F.lit("Histórico").alias("nome"),
                            F.lit("Histórico").alias("tipo_linha"))
    ahead = previsto.select("serie", "dia", "valor", label("modelo", MODEL_LABELS).alias("nome"),
                            F.lit("Previsão").alias("tipo_linha"))
    return history.unionByName(ahead)

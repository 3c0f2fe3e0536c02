"""The registered queries: each operator over the whole of its input tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bankrec import session
from bankrec.functions.text import company_key, strip_accents
from bankrec.functions.values import cosine, money_lenient, money_strict
from bankrec.operators import (anomaly, balances, boosting, cases, cashflow, forecast, ingest, monitoring,
                               reconcile, recursions, reports, series, similarity, suggestions, transcripts)
from bankrec.plans import ledger, stored, workbooks
from bankrec.session import ensure_checkpoint_dir
from bankrec.sources import logs, plan_sheet, statements, workbook

Query = Callable[[SparkSession, str], DataFrame]
NOW = datetime(2024, 1, 30, 13, 15)              # 13:15 in Lisbon and in UTC
COMPANY = "Customer#000000007"
ACCOUNT = "CONTA 7"


def plain(df: DataFrame, digits: int | None = None) -> DataFrame:
    """Money as double, counts as bigint, days as text; models rounded to ``digits``."""
    def cast(f: T.StructField):
        c = F.col(f.name)
        if isinstance(f.dataType, T.DecimalType):
            return c.cast("double").alias(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return c.cast("bigint").alias(f.name)
        if isinstance(f.dataType, (T.DateType, T.TimestampType)):
            return c.cast("string").alias(f.name)
        if digits is not None and isinstance(f.dataType, T.DoubleType):
            return F.round(c, digits).alias(f.name)
        return c
    return df.select([cast(f) for f in df.schema.fields])


def _span(rows: DataFrame) -> tuple[date, date]:
    """First and last day of a table."""
    return tuple(rows.agg(F.min("dia"), F.max("dia")).first())


def _joined(col: str) -> Column:
    return F.array_join(F.col(col).cast("array<string>"), ",").alias(col)


# ---- text and money --------------------------------------------------------

def company_keys(spark, sf):
    names = ledger.movements(spark, sf).select("empresa").distinct()
    return names.select("empresa", strip_accents("empresa").alias("sem_acentos"),
                        company_key("empresa").alias("chave"))


def money_parse(spark, sf):
    m = ledger.movements(spark, sf).select("id", "valor")
    shown = F.translate(F.format_number(F.col("valor"), 2), ",.", ".,")
    lenient = F.when(F.col("id") % 7 == 0, "n/d").otherwise(F.concat(F.lit(" "), shown, F.lit(" EUR ")))
    return plain(m.select("id", money_lenient(lenient).alias("valor"),
                          money_strict(shown).alias("valor_estrito")))


# ---- reconciliation --------------------------------------------------------

def _ledger(spark, sf) -> tuple[DataFrame, DataFrame]:
    return ledger.movements(spark, sf), ledger.lines(spark, sf)


def _run(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Movements, lines and the classified movements; the last is read more than once."""
    ensure_checkpoint_dir(spark)
    m, lines = _ledger(spark, sf)
    return m, lines, reconcile.classify(m, lines).checkpoint()


def reconcile_status(spark, sf):
    return reconcile.classify(*_ledger(spark, sf)).select("id", "tipo_match", "linha_id")


def reconcile_summary(spark, sf):
    return plain(reconcile.summary(*_ledger(spark, sf)))


def reconcile_rerun(spark, sf):
    """Movements arriving in two waves, and a third run that finds nothing to do."""
    ensure_checkpoint_dir(spark)
    m, lines = _ledger(spark, sf)
    first = reconcile.classify(m.where("id % 3 = 0"), lines).checkpoint()
    done = reconcile.reconciliations(first)
    lines = reconcile.lines_after(lines, first)
    second = reconcile.classify(reconcile.pending(m, done), lines).checkpoint()
    done = done.unionByName(reconcile.reconciliations(second))
    lines = reconcile.lines_after(lines, second)
    third = reconcile.reconciliations(reconcile.classify(reconcile.pending(m, done), lines))
    return done.unionByName(third).select(F.col("movimento_id").alias("id"), "tipo_match")


def plan_after_match(spark, sf):
    m, lines = _ledger(spark, sf)
    after = reconcile.lines_after(lines, reconcile.classify(m, lines))
    return plain(after.select("id", "previsto", "pago"))


def _with_pages(found: DataFrame, pages: DataFrame) -> DataFrame:
    """A row per case and a row per page of candidates of their groups."""
    return plain(found.unionByName(pages, allowMissingColumns=True))


def ambiguous_cases(spark, sf):
    """Each case with the ids of all its candidates."""
    _, lines, run = _run(spark, sf)
    found = cases.with_candidates(cases.ambiguous_cases(run), cases.candidates(run, lines))
    return plain(found.select("movimento_id", "valor", _joined("candidatos")))


def audit_before(spark, sf):
    return plain(reconcile.audit(*_ledger(spark, sf)))


def audit_after(spark, sf):
    m, lines = _ledger(spark, sf)
    after = reconcile.lines_after(lines, reconcile.classify(m, lines))
    return plain(reconcile.audit(m, after))


def movement_status(spark, sf):
    m, lines = _ledger(spark, sf)
    recs = reconcile.reconciliations(reconcile.classify(m, lines))
    return reconcile.movement_status(m, recs, lines).select("id", "tipo_match", "linha_id",
                                                            "linha_imputacao")


def state_counts(spark, sf):
    m, lines = _ledger(spark, sf)
    recs = reconcile.reconciliations(reconcile.classify(m.where("dayofmonth(dia) % 2 = 0"), lines))
    return plain(reconcile.state_counts(reconcile.movement_status(m, recs, lines)))


def state_report(spark, sf):
    m, lines = _ledger(spark, sf)
    recs = reconcile.reconciliations(reconcile.classify(m, lines))
    return plain(reports.state_report(reconcile.state_counts(reconcile.movement_status(m, recs, lines))))


def decisions_rejected(spark, sf):
    """Decisions for lines that are no candidates, and for cases that do not exist."""
    _, lines, run = _run(spark, sf)
    found, options = cases.ambiguous_cases(run), cases.candidates(run, lines)
    known = F.col("id") % 3 != 0
    decisions = found.select(F.when(known, F.col("id")).otherwise(-F.col("id")).alias("caso_id"), (-F.col("id")).alias("linha_id"),
                             F.lit("tesouraria").alias("resolvido_por"), F.lit(NOW).alias("ts"))
    return cases.apply_decisions(decisions, found, options, reconcile.reconciliations(run), lines).rejeitados


def _decided(spark, sf):
    """Ambiguous cases with a decision on each: the lowest candidate, or none."""
    m, lines, run = _run(spark, sf)
    found, options = cases.ambiguous_cases(run), cases.candidates(run, lines)
    lowest = options.groupBy("grupo").agg(F.min("linha_id").alias("linha_id"))
    decisions = found.join(lowest, "grupo").select(
        F.col("id").alias("caso_id"), F.when(F.col("id") % 3 != 0, F.col("linha_id")).alias("linha_id"),
        F.lit("tesouraria").alias("resolvido_por"), F.lit(NOW).alias("ts"))
    return m, lines, run, found, options, decisions


def apply_decisions(spark, sf):
    _, lines, run, found, options, decisions = _decided(spark, sf)
    done = cases.apply_decisions(decisions, found, options, reconcile.reconciliations(run), lines)
    return done.casos.join(done.reconciliacoes.select("movimento_id", "tipo_match"), "movimento_id").select(
        F.col("id").alias("caso_id"), "resolucao", "tipo_match")


def _half_resolved(spark, sf):
    """Cases with the decisions that name a line applied; the rest stay open."""
    m, lines, run, found, options, decisions = _decided(spark, sf)
    named = decisions.where("linha_id is not null")
    done = cases.apply_decisions(named, found, options, reconcile.reconciliations(run), lines)
    return m, lines, done.casos.checkpoint(), options


def open_cases(spark, sf):
    """Unresolved cases, and once per group the details of their candidates."""
    _, lines, found, options = _half_resolved(spark, sf)
    shown = F.transform("candidatos_detalhe", lambda d: F.concat_ws(
        ":", d["id"].cast("string"), d["linha"].cast("string"), d["tipo"], d["imputacao"]))
    pages = cases.pages(cases.of_open_cases(options, found), lines)
    return _with_pages(found.where("resolvido_por is null").select(F.col("id").alias("caso_id"), "n_candidatos", "grupo"),
                       pages.select("grupo", "pagina", F.array_join(shown, ",").alias("linhas")))


def queue_size(spark, sf):
    return cases.queue_size(_half_resolved(spark, sf)[2])


# ---- cash-flow and balances ------------------------------------------------

def companies(spark, sf):
    return cashflow.companies(ledger.movements(spark, sf))


def company_history(spark, sf):
    return plain(cashflow.company_history(ledger.movements(spark, sf), COMPANY))


def daily_summary(spark, sf):
    return plain(cashflow.daily_summary(ledger.flows(spark, sf)))


def day_totals(spark, sf):
    return plain(cashflow.day_totals(ledger.flows(spark, sf)))


def month_to_date(spark, sf):
    return plain(cashflow.month_to_date(ledger.movements(spark, sf)))


def summary_unpivot(spark, sf):
    return plain(reports.unpivot_series(cashflow.daily_summary(ledger.flows(spark, sf)), ["dia"],
                                        ["recebimentos", "pagamentos"]))


def balance_unpivot(spark, sf):
    return plain(reports.unpivot_series(ledger.balances(spark, sf), ["entidade", "dia"],
                                        ["saldo_contabilistico", "saldo_disponivel"]))


def company_daily_net(spark, sf):
    return plain(cashflow.company_daily_net(ledger.flows(spark, sf)))


def balance_lookup(spark, sf):
    return plain(balances.lookup(ledger.balances(spark, sf), ACCOUNT)
                 .select("dia", "entidade", "saldo_contabilistico", "saldo_disponivel"))


def balances_latest(spark, sf):
    return plain(balances.latest(ledger.balances(spark, sf)).drop("id"))


def balances_asof(spark, sf):
    days = _span(ledger.flows(spark, sf))
    return plain(balances.latest_between(ledger.balances(spark, sf), *days).drop("id"))


def balance_total(spark, sf):
    days = _span(ledger.flows(spark, sf))
    daily = balances.latest_between(ledger.balances(spark, sf), *days)
    return plain(balances.total(daily, ["em"]))


def balance_top10(spark, sf):
    return plain(balances.top(balances.latest(ledger.balances(spark, sf))))


# ---- series and forecasts --------------------------------------------------

def _net(spark, sf) -> DataFrame:
    return series.net_series(series.cashflow_series(ledger.flows(spark, sf)))


def balance_series(spark, sf):
    return plain(series.balance_series(ledger.balances(spark, sf)))


def cashflow_series(spark, sf):
    return plain(series.cashflow_series(ledger.flows(spark, sf)).drop("t"))


def forecast_linear(spark, sf):
    out = forecast.forecast_simple(_net(spark, sf)).where(F.col("modelo") == forecast.LINEAR)
    return plain(out.drop("modelo"), 4)


def forecast_moving_average(spark, sf):
    out = forecast.forecast_simple(_net(spark, sf)).where(F.col("modelo") == forecast.AVERAGE)
    return plain(out.drop("modelo"), 4)


def forecast_features(spark, sf):
    return plain(series.features(_net(spark, sf)).drop("t"), 4)


def forecast_too_short(spark, sf):
    short = forecast.too_short(series.balance_series(ledger.balances(spark, sf)), 25)
    return plain(short)


def chart_series(spark, sf):
    net = _net(spark, sf)
    return plain(forecast.chart_series(net, forecast.forecast_simple(net)), 4)


def backtest_simple(spark, sf):
    return plain(forecast.backtest(_net(spark, sf), only_simple=True).drop("falha"), 4)


def best_simple_model(spark, sf):
    scores = forecast.backtest(_net(spark, sf), only_simple=True)
    return forecast.best_model(scores).select("serie", "melhor_modelo")


def rmse_table(spark, sf):
    return plain(forecast.rmse_table(forecast.backtest(_net(spark, sf), only_simple=True), series.PORTFOLIO), 4)


def forecast_holt(spark, sf):
    return plain(forecast.forecast_with(_net(spark, sf), recursions.HOLT).drop("modelo"), 4)


def forecast_arima(spark, sf):
    return plain(forecast.forecast_with(_net(spark, sf), recursions.ARIMA).drop("modelo"), 4)


def forecast_markov(spark, sf):
    return plain(forecast.forecast_with(_net(spark, sf), recursions.MARKOV).drop("modelo"), 4)


def forecast_boosting(spark, sf):
    return plain(forecast.forecast_with(_net(spark, sf), boosting.BOOSTING).drop("modelo"), 4)


def forecast_balance(spark, sf):
    return plain(forecast.balance(ledger.balances(spark, sf)), 4)


def forecast_cashflow(spark, sf):
    return plain(forecast.cashflow(ledger.flows(spark, sf)), 4)


def feature_importance(spark, sf):
    return plain(forecast.feature_importance(_net(spark, sf)), 4)


def backtest_all(spark, sf):
    scores = forecast.backtest(_net(spark, sf), boosting=True)
    # one fit serves the table and the choice of the best
    ranked = scores.groupBy("serie").agg(
        F.collect_list(F.struct("modelo", "rmse", "falha")).alias("m"),
        F.min_by("modelo", F.when(F.col("rmse").isNotNull(), F.struct("rmse", forecast.model_order()))).alias("melhor"))
    return plain(ranked.select("serie", F.inline("m"), "melhor"), 4)


# ---- anomalies -------------------------------------------------------------

def anomaly_eligible(spark, sf):
    return anomaly.eligible(ledger.flows(spark, sf))


def anomaly_models(spark, sf):
    """Size and range of each company's forest."""
    return plain(anomaly.fit(ledger.flows(spark, sf)).selectExpr(
        "empresa", "size(cortes) as n_cortes", "array_min(notas) as menor", "array_max(notas) as maior"), 6)


def anomaly_flags(spark, sf):
    return plain(anomaly.flag(ledger.flows(spark, sf)).select("id", "empresa", "valor", "score"), 4)


# ---- monitoring ------------------------------------------------------------

def script_status(spark, sf):
    return reports.status_badge(monitoring.script_status(ledger.executions(spark, sf), NOW))


def overdue(spark, sf):
    return monitoring.script_status(ledger.executions(spark, sf), NOW).select(
        "nome", "atrasado", "hora_em_falta")


def late_scripts(spark, sf):
    return monitoring.late_scripts(monitoring.script_status(ledger.executions(spark, sf), NOW))


def recent_runs(spark, sf):
    return monitoring.recent_runs(ledger.executions(spark, sf)).withColumn(
        "detalhe", F.array_join("detalhe", "\n"))


def runs_of_script(spark, sf):
    return monitoring.runs_of(ledger.executions(spark, sf), "ERROR").withColumn(
        "detalhe", F.array_join("detalhe", "\n"))


def record_runs(spark, sf):
    reported = (ledger.executions(spark, sf)
                .withColumn("script", F.concat(F.lit("  "), F.initcap("script"), F.lit(" ")))
                .withColumn("log", F.when(F.col("id") % 2 == 0, F.col("log"))))
    return plain(monitoring.record_runs(reported).select("id", "script", "status",
                                                         F.size("log").alias("n_log")))


def log_errors(spark, sf):
    found = logs.error_lines(ledger.log_lines(spark, sf))
    return plain(found.groupBy("dia").agg(F.count("*").alias("n")))


# ---- similarity, suggestions, transcripts ----------------------------------

def similar_cases(spark, sf):
    opened, resolved = ledger.case_vectors(spark, sf)
    return plain(similarity.top_k(opened, resolved).drop("similaridade"))


def case_cosines(spark, sf):
    """Each vector and the one with the next id."""
    v = ledger.load(spark, sf, "embeddings").select("vec_id", "embedding")
    following = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("seguinte"))
    return plain(v.join(following, "vec_id").select("vec_id", cosine("embedding", "seguinte").alias("semelhanca")), 6)


def prompts(spark, sf):
    """Prompts for the open cases, and once per group the texts of their candidates; every
    case has one of the vectors."""
    m, lines, found, options = _half_resolved(spark, sf)
    vectors = ledger.load(spark, sf, "embeddings").select("vec_id", "embedding")
    place = F.expr(f"(id div 2) % {max(1, vectors.count())}").alias("vec_id")
    own = found.select(F.col("id").alias("caso_id"), "resolvido_por", place).join(vectors, "vec_id").drop("vec_id").checkpoint()
    # read twice, as hot neighbours are counted before they are joined
    near = session.stored(similarity.top_k(own.where("resolvido_por is null").select("caso_id", "embedding"),
                                           own.where("resolvido_por is not null").select("caso_id", "embedding")))
    return _with_pages(suggestions.prompt_parts(found, m, near),
                       suggestions.candidate_texts(cases.of_open_cases(options, found), lines))


def _answers(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Cases and answers of four kinds, by case: a line, no line, no JSON, JSON inside text.
    Each case has an earlier answer, which does not count, and every third id is also
    answered with its sign changed, which is no case."""
    _, lines, run = _run(spark, sf)
    found = cases.ambiguous_cases(run)
    kind = F.pmod(F.floor(F.col("id") / 2), F.lit(4))
    line = F.concat(F.lit('{"linha_id": '), F.col("grupo").cast("string"),
                    F.lit(', "justificacao": "bate com o histórico"}'))
    answer = (F.when(kind == 0, line).when(kind == 1, F.lit('{"linha_id": null, "justificacao": "nenhuma"}'))
              .when(kind == 2, F.concat(F.lit("não sei, caso "), F.col("id").cast("string")))
              .otherwise(F.concat(F.lit("Claro:\n"), line, F.lit("\nEspero ter ajudado."))))
    last = F.struct(F.col("id").alias("caso_id"), answer.alias("texto"), F.lit(NOW).alias("ts"))
    earlier = F.struct(F.col("id").alias("caso_id"), F.lit("{}").alias("texto"), F.lit(NOW - timedelta(hours=1)).alias("ts"))
    astray = F.struct((-F.col("id")).alias("caso_id"), answer.alias("texto"), F.lit(NOW).alias("ts"))
    given = F.when(F.col("id") % 3 == 0, F.array(last, earlier, astray)).otherwise(F.array(earlier, last))
    return found, found.select(F.inline(given))


def suggestions_parsed(spark, sf):
    return suggestions.apply_suggestions(*_answers(spark, sf)).select(
        F.col("id").alias("caso_id"), "resolucao_sugerida", "justificacao_sugerida", "resolvido_por")


def answers_rejected(spark, sf):
    return suggestions.rejected_answers(*_answers(spark, sf)).select("caso_id", "motivo")


def folded_transcripts(spark, sf):
    return plain(transcripts.fold(ledger.transcripts(spark, sf)).withColumn(
        "ferramentas", F.array_join("ferramentas", "\n")))


# ---- imports ---------------------------------------------------------------

def import_plan(spark, sf):
    """Actions for every day of the ledger and the day after, with the even days and the
    last one stored already."""
    m, lines = _ledger(spark, sf)
    first, last = _span(m.select("dia").union(lines.select("dia")))
    days = m.select("dia").distinct()
    tables = lambda df, names: df.select(
        "dia", F.explode(F.array(*[F.lit(n) for n in names])).alias("tabela"))
    files = tables(days, [ingest.MOVEMENTS, ingest.BALANCES]).unionByName(
        tables(lines.select("dia").distinct(), [ingest.PLAN]))
    stored = files.where((F.dayofmonth("dia") % 2 == 0) | (F.col("dia") == F.lit(last)))
    return plain(ingest.plan_days(last + timedelta(days=1), (last - first).days + 1, files, stored))


def workbook_import(spark, sf):
    """Statements rendered from the flows and read back: movements and balances."""
    files = workbooks.statement_files(ledger.flows(spark, sf), ledger.balances(spark, sf), "raiz")
    cells = session.stored(workbook.cells(files))
    moved = statements.statement_movements(cells).groupBy("dia", "empresa").agg(
        F.count("*").alias("n"), F.sum("valor").alias("total"))
    closing = statements.statement_balances(cells).select(
        "dia", F.col("entidade").alias("empresa"), "saldo_contabilistico", "saldo_disponivel")
    return plain(moved.join(closing, ["dia", "empresa"], "full_outer"))


def plan_import(spark, sf):
    """Plan workbooks rendered from the lines and read back."""
    cells = session.stored(workbook.cells(workbooks.plan_files(ledger.lines(spark, sf), "raiz")))
    return plain(plan_sheet.plan_lines(cells).groupBy("dia", "tipo", "chave").agg(
        F.count("*").alias("n"), F.sum("previsto").alias("previsto"), F.sum("pago").alias("pago"),
        F.max("imputacao").alias("imputacao")))


QUERIES: dict[str, Query] = {q.__name__: q for q in (
    company_keys, money_parse, reconcile_status, reconcile_summary, reconcile_rerun,
    plan_after_match, ambiguous_cases, audit_before, audit_after, movement_status, state_counts, state_report, decisions_rejected,
    apply_decisions, open_cases, queue_size, companies, company_history, daily_summary, day_totals,
    month_to_date, summary_unpivot, balance_unpivot, company_daily_net, balance_lookup,
    balances_latest, balances_asof, balance_total, balance_top10, balance_series, cashflow_series,
    forecast_linear, forecast_moving_average, forecast_features, forecast_too_short, chart_series,
    backtest_simple, rmse_table, case_cosines, best_simple_model, forecast_holt, forecast_arima, forecast_markov, forecast_boosting, forecast_balance, forecast_cashflow, feature_importance,
    backtest_all, anomaly_eligible, anomaly_models, anomaly_flags, script_status, overdue, late_scripts,
    recent_runs, runs_of_script, record_runs, log_errors, similar_cases, prompts, answers_rejected, import_plan,
    workbook_import, plan_import)}
QUERIES["suggestions"] = suggestions_parsed
QUERIES["transcripts"] = folded_transcripts
QUERIES |= stored.QUERIES

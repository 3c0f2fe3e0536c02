"""The queue of ambiguous movements and the decisions people take on it.

All movements of a group share the same candidate lines, so candidates are stored
once per group, in ``(grupo, linha_id)`` rows. Reports put them into pages that
cases refer to by ``grupo``, so a group of m movements and n lines makes m + n rows at most,
and no row holds more than a page. Lists copied to each case are for a screenful of cases.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankrec import skew
from bankrec.operators.reconcile import KEYS, open_lines


PAGE_LINES = 1000        # on average; a group's lines are dealt out to its pages by their id
_PRIME, _ROOT = (1 << 31) - 1, 16807


def ambiguous_cases(classificados: DataFrame) -> DataFrame:
    """One open case per ambiguous movement; the movement id is the case id."""
    nothing = F.lit(None).cast("string")
    return classificados.where("tipo_match = 'ambiguo'").select(
        "id", F.col("id").alias("movimento_id"), "dia", "empresa", "valor", "grupo",
        F.col("n_linhas").alias("n_candidatos"), nothing.alias("resolvido_por"),
        nothing.alias("resolucao"), nothing.alias("resolucao_sugerida"),
        nothing.alias("justificacao_sugerida"))


def candidates(classificados: DataFrame, linhas: DataFrame) -> DataFrame:
    """``(dia, grupo, linha_id, n_candidatos)``: the open lines of each ambiguous group."""
    groups = (classificados.where("tipo_match = 'ambiguo'").groupBy(*KEYS)
              .agg(F.min("grupo").alias("grupo"), F.min("n_linhas").alias("n_candidatos")))
    return (skew.join_lookup(open_lines(linhas), groups, KEYS, "inner", by="id")
            .select("dia", "grupo", F.col("id").alias("linha_id"), "n_candidatos"))


def candidate_lists(candidatos: DataFrame) -> DataFrame:
    """Sorted candidate ids per group."""
    return (candidatos.groupBy("grupo")
            .agg(F.array_sort(F.collect_list("linha_id")).alias("candidatos")))


def with_candidates(casos: DataFrame, candidatos: DataFrame) -> DataFrame:
    return skew.join_lookup(casos, candidate_lists(candidatos), ["grupo"], "left", by="id")


def candidate_details(candidatos: DataFrame, linhas: DataFrame) -> DataFrame:
    """Candidates with the line they point to, one row each."""
    return candidatos.join(
        linhas.select(F.col("id").alias("linha_id"), "linha", "tipo", "empresa", "previsto",
                      "imputacao"), "linha_id", "left")


def paged(candidatos: DataFrame, lines: int = PAGE_LINES) -> DataFrame:
    """Candidates with the ``pagina`` (from 0) of their group that they are on. A line's page
    depends on its id and the group's size alone, so no task numbers a group."""
    page = f"cast(pmod(linha_id, {_PRIME}L) * {_ROOT} % {_PRIME} % ceil(n_candidatos / {lines}) as bigint)"
    return candidatos.withColumn("pagina", F.expr(page))


def of_open_cases(candidatos: DataFrame, casos: DataFrame) -> DataFrame:
    """Candidates of the groups that have an unresolved case."""
    groups = casos.where("resolvido_por is null").select("grupo").distinct()
    return skew.join_lookup(candidatos, groups, ["grupo"], "inner", by="linha_id")


def pages(candidatos: DataFrame, linhas: DataFrame, lines: int = PAGE_LINES) -> DataFrame:
    """``(grupo, pagina, candidatos_detalhe)``: the candidates of each group with their
    details, sorted by id on each page. A group without candidates has no page."""
    detail = F.struct(F.col("linha_id").alias("id"), "linha", "tipo", "empresa", "previsto", "imputacao")
    return (candidate_details(paged(candidatos, lines), linhas).groupBy("grupo", "pagina")
            .agg(F.array_sort(F.collect_list(detail)).alias("candidatos_detalhe")))


def open_cases(casos: DataFrame, candidatos: DataFrame, linhas: DataFrame) -> DataFrame:
    """Unresolved cases with the details of their candidates."""
    detail = F.struct(F.col("linha_id").alias("id"), "linha", "tipo", "empresa", "previsto",
                      "imputacao")
    lists = (candidate_details(candidatos, linhas)
             .groupBy("grupo").agg(F.array_sort(F.collect_list(detail)).alias("candidatos_detalhe")))
    return skew.join_lookup(casos.where("resolvido_por is null"), lists, ["grupo"], "left", by="id")


def queue_size(casos: DataFrame) -> DataFrame:
    return casos.agg(F.count_if(F.col("resolvido_por").isNull()).alias("por_resolver"))


@dataclass
class Decided:
    casos: DataFrame
    reconciliacoes: DataFrame
    linhas: DataFrame
    rejeitados: DataFrame


def apply_decisions(decisoes: DataFrame, casos: DataFrame, candidatos: DataFrame,
                    reconciliacoes: DataFrame, linhas: DataFrame) -> Decided:
    """Apply a batch of decisions ``(caso_id, linha_id, resolvido_por, ts)``; a null
    line means "none of them, it is new".

    As when decisions come one by one: the case shows the last one, every chosen
    line becomes paid, and the reconciliation follows the first one, because after
    it the movement is no longer ambiguous. Unknown cases and lines that are not
    candidates are rejected.
    """
    cases = casos.select(F.col("id").alias("caso_id"), "grupo", "movimento_id",
                         F.col("valor").alias("caso_valor"))
    known = decisoes.join(cases, "caso_id", "left")
    allowed = candidatos.select("grupo", "linha_id", F.lit(True).alias("_candidato"))
    to_line = skew.join_lookup(known.where("movimento_id is not null and linha_id is not null"),
                               allowed, ["grupo", "linha_id"], "left", by="caso_id")
    valid = (to_line.where("_candidato").drop("_candidato")
             .unionByName(known.where("movimento_id is not null and linha_id is null")))
    rejected = (known.where("movimento_id is null").select("caso_id", "linha_id",
                                                           F.lit("caso desconhecido").alias("motivo"))
                .unionByName(to_line.where("_candidato is null").select(
                    "caso_id", "linha_id", F.lit("linha não é candidata").alias("motivo"))))

    order = F.struct("ts", "linha_id", "resolvido_por")
    per_case = valid.groupBy("caso_id", "movimento_id").agg(
        F.min_by("linha_id", order).alias("primeira"),
        F.max_by(F.struct("linha_id", "resolvido_por"), order).alias("ultima"))

    decided = per_case.select(
        F.col("caso_id").alias("id"),
        F.coalesce(F.concat(F.lit("linha_id="), F.col("ultima.linha_id").cast("string")),
                   F.lit("novo")).alias("_resolucao"),
        F.col("ultima.resolvido_por").alias("_por"))
    new_cases = (casos.join(decided, "id", "left")
                 .withColumn("resolucao", F.coalesce("_resolucao", "resolucao"))
                 .withColumn("resolvido_por", F.coalesce("_por", "resolvido_por"))
                 .select(*casos.columns))

    change = (F.col("tipo_match") == "ambiguo") & F.col("_decidido")
    new_recs = (reconciliacoes
                .join(per_case.select("movimento_id", "primeira", F.lit(True).alias("_decidido")),
                      "movimento_id", "left")
                .withColumn("linha_id", F.when(change, F.col("primeira")).otherwise(F.col("linha_id")))
                .withColumn("tipo_match", F.when(change & F.col("primeira").isNull(), "novo")
                            .when(change, "exato").otherwise(F.col("tipo_match")))
                .select(*reconciliacoes.columns))

    paid = (valid.where("linha_id is not null").groupBy(F.col("linha_id").alias("id"))
            .agg(F.max("caso_valor").alias("_valor")))
    new_lines = (linhas.join(paid, "id", "left").withColumn("pago", F.coalesce("_valor", "pago"))
                 .select(*linhas.columns))
    return Decided(new_cases, new_recs, new_lines, rejected)

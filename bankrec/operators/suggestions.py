"""Prompts for open cases and the answers to them. Asking is left to others: one
job writes the prompt table, another reads the table of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankrec import skew
from bankrec.functions.text import case_text, line_text
from bankrec.operators.cases import PAGE_LINES, candidate_details, of_open_cases, paged

# Texts for "no examples" and for answers that are not JSON.
NO_EXAMPLES = "(sem casos parecidos resolvidos anteriormente)"
NOT_JSON = "[resposta do LLM não veio em JSON válido] "


def case_texts(casos: DataFrame, movimentos: DataFrame) -> DataFrame:
    """``(caso_id, texto)``; the description is blank when the movement is gone."""
    described = movimentos.select(F.col("id").alias("movimento_id"), "descricao")
    text = case_text(F.col("empresa"), F.col("descricao"), F.col("valor"))
    return (casos.join(described, "movimento_id", "left")
            .select(F.col("id").alias("caso_id"), text.alias("texto")))


def candidate_texts(candidatos: DataFrame, linhas: DataFrame, lines: int = PAGE_LINES) -> DataFrame:
    """``(grupo, pagina, texto)``: the pages of each group's candidates as text, a line each."""
    detail = candidate_details(paged(candidatos, lines), linhas)
    text = F.concat(F.lit("- "), line_text(F.col("linha"), F.col("tipo"), F.col("empresa"),
                                           F.col("previsto"), F.col("imputacao")))
    return (detail.groupBy("grupo", "pagina")
            .agg(F.array_sort(F.collect_list(F.struct("linha_id", text.alias("t")))).alias("l"))
            .select("grupo", "pagina", F.array_join("l.t", "\n").alias("texto")))


def prompt_parts(casos: DataFrame, movimentos: DataFrame, vizinhos: DataFrame) -> DataFrame:
    """``(caso_id, grupo, antes, depois)`` for each unresolved case: its prompt up to the
    candidates and after them. The candidates are in ``candidate_texts``, once per group.
    ``vizinhos`` is the answer of ``similarity.top_k``."""
    texts = case_texts(casos, movimentos)
    solved = (casos.where("resolvido_por is not null")
              .select(F.col("id").alias("vizinho_id"), "resolucao")
              .join(texts.select(F.col("caso_id").alias("vizinho_id"), "texto"), "vizinho_id"))
    example = F.format_string("- Caso: %s -> resolvido como: %s (similaridade %.2f)",
                              F.col("texto"), F.col("resolucao"), F.col("similaridade"))
    examples = (skew.join_lookup(vizinhos, solved, ["vizinho_id"], "inner", by="caso_id")
                .groupBy("caso_id")
                .agg(F.array_sort(F.collect_list(F.struct("rank", example.alias("t")))).alias("e"))
                .select(F.col("caso_id").alias("id"), F.array_join("e.t", "\n").alias("_exemplos")))
    before = F.concat_ws(
        "\n",
        F.lit("Este movimento bancário corresponde a várias linhas do mapa com a mesma empresa "
              "e o mesmo valor. Escolhe a linha certa, ou nenhuma se for um movimento novo."),
        F.format_string("Movimento: %s | valor %s EUR", F.col("empresa"), F.col("valor").cast("string")),
        F.lit("Linhas candidatas:"))
    after = F.concat_ws(
        "\n",
        F.lit("Casos parecidos já resolvidos:"), F.coalesce("_exemplos", F.lit(NO_EXAMPLES)),
        F.lit('Responde só com JSON: {"linha_id": <id ou null>, "justificacao": "<texto curto>"}'))
    return casos.where("resolvido_por is null").join(examples, "id", "left").select(
        F.col("id").alias("caso_id"), "grupo", before.alias("antes"), after.alias("depois"))


def prompts(casos: DataFrame, candidatos: DataFrame, linhas: DataFrame, movimentos: DataFrame,
            vizinhos: DataFrame) -> DataFrame:
    """``(caso_id, prompt)`` for each unresolved case, whole, as it is sent: each prompt holds
    all pages of its group. ``prompt_parts`` is the form to store."""
    texts = candidate_texts(of_open_cases(candidatos, casos), linhas)
    lines = (texts.groupBy("grupo").agg(F.array_sort(F.collect_list(F.struct("pagina", "texto"))).alias("p"))
             .select("grupo", F.array_join("p.texto", "\n").alias("_linhas")))
    parts = skew.join_lookup(prompt_parts(casos, movimentos, vizinhos), lines, ["grupo"], "left", by="caso_id")
    return parts.select("caso_id", F.concat_ws("\n", "antes", F.coalesce("_linhas", F.lit("")), "depois").alias("prompt"))


def parse_answers(respostas: DataFrame) -> DataFrame:
    """``(caso_id, resolucao_sugerida, justificacao_sugerida)`` from answers
    ``(caso_id, texto, ts)``, the latest of a case by ``ts``, ties by text: the JSON object
    inside the text, or no suggestion and the text itself with a marker."""
    if "ts" not in respostas.columns:
        raise ValueError("answers need a column ts, the latest of a case counts")
    found = F.regexp_extract("texto", r"(?s)\{.*\}", 0)
    # read as a list of one, so that anything after the object makes it invalid
    parsed = F.from_json(F.concat(F.lit("["), found, F.lit("]")),
                         "array<struct<linha_id:string,justificacao:string>>",
                         {"allowSingleQuotes": "false"})
    latest = F.max_by("texto", F.struct("ts", "texto"))
    answers = (respostas.groupBy("caso_id").agg(F.coalesce(latest, F.lit("")).alias("texto"))
               .withColumn("j", parsed)
               .withColumn("ok", F.col("j").isNotNull() & (F.size("j") == 1) & (found != "")))
    line = F.col("j")[0]["linha_id"]
    chosen = F.when(line.isNull(), "novo").otherwise(F.concat(F.lit("linha_id="), line))
    return answers.select(
        "caso_id", F.when(F.col("ok"), chosen).alias("resolucao_sugerida"),
        F.when(F.col("ok"), F.col("j")[0]["justificacao"])
        .otherwise(F.concat(F.lit(NOT_JSON), "texto")).alias("justificacao_sugerida"))


def rejected_answers(casos: DataFrame, respostas: DataFrame) -> DataFrame:
    """``(caso_id, texto, ts, motivo)``: answers to cases that do not exist, or to none."""
    return (respostas.join(casos.select(F.col("id").alias("caso_id")), "caso_id", "left_anti")
            .select("caso_id", "texto", "ts", F.lit("caso desconhecido").alias("motivo")))


def apply_suggestions(casos: DataFrame, respostas: DataFrame) -> DataFrame:
    """Cases with the suggestions stored; they stay unresolved. Answers to unknown cases are
    in ``rejected_answers``."""
    new = parse_answers(respostas).select(
        F.col("caso_id").alias("id"), F.col("resolucao_sugerida").alias("_s"),
        F.col("justificacao_sugerida").alias("_j"), F.lit(True).alias("_tem"))
    pick = lambda ours, old: F.when(F.col("_tem"), F.col(ours)).otherwise(F.col(old))
    return (casos.join(new, "id", "left").withColumn("resolucao_sugerida", pick("_s", "resolucao_sugerida"))
            .withColumn("justificacao_sugerida", pick("_j", "justificacao_sugerida"))
            .select(*casos.columns))

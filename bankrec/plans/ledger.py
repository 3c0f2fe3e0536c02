"""Ledger tables derived from the test tables, so every operator has input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bankrec.functions.text import company_key

_MONEY = "decimal(18,2)"
# the columns in use; named here so that no file has to be opened for its schema
_SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    # keys are made once per company, not once per order
    named = load(spark, sf_dir, "customer").selectExpr(
        "*", "concat(upper(c_name), ',LDA') as nome_lda", "concat(c_name, ' SA') as nome_sa")
    keyed = named.select("*", company_key("c_name").alias("chave"),
                         company_key("nome_lda").alias("chave_lda"), company_key("nome_sa").alias("chave_sa"))
    joined = load(spark, sf_dir, "orders").join(keyed, F.expr("o_custkey = c_custkey"))
    return joined.selectExpr(
        "o_orderkey as k", "to_date(o_orderdate) as dia", "c_name", "nome_lda", "nome_sa", "chave",
        "chave_lda", "chave_sa", "o_orderpriority",
        "cast(case when o_orderstatus = 'F' then -o_totalprice else o_totalprice end as decimal(18,2)) as v")


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter A: one movement per order, some of them twice. Copies come from one
    scan by exploding, not from a second read."""
    rows = _orders(spark, sf_dir).where("k % 10 <> 9").selectExpr(
        "*", "explode(if(k % 17 = 0, array(0, 1), array(0))) as c")
    empresa = "if(c = 0, nome_lda, c_name)"
    return rows.selectExpr(
        "2 * k + c as id", "dia", f"{empresa} as empresa", "o_orderpriority as descricao", "v as valor",
        f"concat(date_format(dia, 'dd-MM-yyyy'), '_', {empresa}, '.xlsx') as ficheiro_origem",
        "if(c = 0, chave_lda, chave) as chave")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter A: one planned line per order, some of them twice, some already paid."""
    rows = _orders(spark, sf_dir).where("k % 7 <> 6").selectExpr(
        "*", "explode(if(k % 11 = 0, array(0, 1), array(0))) as c")
    return rows.selectExpr(
        "2 * k + c as id", "dia", "if(v >= 0, 'recebimento', 'pagamento') as tipo",
        "cast(5 + k % 40 as int) as linha", "if(c = 0, c_name, nome_sa) as empresa",
        "v as previsto", "case when c = 0 and k % 13 = 0 then v end as pago",
        "concat('IMP', k % 5) as imputacao", "if(c = 0, chave, chave_sa) as chave")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter B: one movement per event."""
    rows = load(spark, sf_dir, "events").selectExpr(
        "event_id as id", "to_date(ts) as dia", "concat('Conta ', user_id, ', SA') as empresa",
        "event_type as descricao",
        "cast(if(event_type in ('error', 'view'), -value, value) as decimal(18,2)) as valor")
    return rows.select("*", F.expr("concat(date_format(dia, 'dd-MM-yyyy'), '_', empresa, '.xlsx')")
                       .alias("ficheiro_origem"), company_key("empresa").alias("chave"))


def balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter B: running sum of each company's daily net, on days with movements."""
    daily = (flows(spark, sf_dir).groupBy("empresa", "dia")
             .agg(F.sum("valor").alias("liquido"), F.min("id").alias("id")))
    running = F.sum("liquido").over(
        W.partitionBy("empresa").orderBy("dia").rowsBetween(W.unboundedPreceding, 0))
    return (daily.select("id", "dia", F.col("empresa").alias("entidade"),
                         running.cast(_MONEY).alias("saldo_contabilistico"))
            .withColumn("saldo_disponivel", (F.col("saldo_contabilistico") * F.lit("0.9").cast(_MONEY))
                        .cast(_MONEY))
            .withColumn("chave", company_key("entidade")))


def executions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter C: one script run per event."""
    failed = F.col("value") > 200
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("script"),
        F.when(failed, "erro").otherwise("ok").alias("status"),
        F.when(failed, F.concat(F.lit("valor "), F.col("value").cast(_MONEY).cast("string"),
                                F.lit(" acima do limite"))).alias("erro"),
        F.array("props").alias("log"), F.col("value").alias("duracao_segundos"),
        F.col("ts").cast("timestamp").alias("ts"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter E: events as lines of a log file."""
    level = (F.when(F.col("event_type") == "error", "ERROR")
             .when(F.col("value") > 200, "Critical").otherwise("INFO"))
    day = F.date_format("ts", "yyyy-MM-dd")
    return load(spark, sf_dir, "events").select(
        F.concat(F.lit("logs/"), day, F.lit("/api.log")).alias("path"),
        F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), level,
                    F.concat(F.lit("script-"), F.col("user_id").cast("string"))).alias("value"))


def case_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Adapter D: open and resolved cases with their vectors."""
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("caso_id"), "embedding")
    return v.where("caso_id % 10 = 0"), v.where("caso_id % 10 <> 0")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter F: conversations, with system rows in the tool role."""
    c = load(spark, sf_dir, "conversations")
    tool = F.col("role") == "system"
    return c.select("conv_id", "turn", F.when(tool, "tool").otherwise(F.col("role")).alias("role"),
                    F.when(~tool, F.col("text")).alias("text"),
                    F.when(tool, F.col("text")).alias("name"))

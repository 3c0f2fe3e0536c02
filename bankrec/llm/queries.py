"""Queries over the text tables, one for each operator."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bankrec.llm import (
    collision_search,
    decontaminate,
    jaccard_join,
    language_id,
    line_dedup,
    line_quality,
    periodic_runs,
    piece_codec,
    prefix_trie,
    quality_classifier,
    ring_shards,
    substring_dedup,
    token_counts,
)
from bankrec.llm.native import let, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def model_bytes(name: str = "piece_bpe_32k.model", folder: str | None = None) -> bytes:
    """A vocabulary file of the public tokenizers, or of another folder; tasks get its content,
    so only the driver needs the file."""
    with open(os.path.join(folder, name) if folder else public_tokenizers.path(name), "rb") as file:
        return file.read()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.remove_repeated(table(spark, sf_dir, "documents"), window=13)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = line_dedup.remove_repeated(docs, size=3)
    return done.select("doc_id", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@_query
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_alike(table(spark, sf_dir, "documents"), size=5, percent=75)


@_query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), model_bytes(), limit=4096)


@_query
def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_quality.assess(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", "kept", "n_line_words")


@_query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    apart = language_id.held_out(3, 1)
    net = language_id.learn(docs.where(~apart))
    return language_id.predict(docs, net).select("doc_id", apart.alias("held_out"), "lang_pred", "score")


@_query
def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = piece_codec.round_trip(table(spark, sf_dir, "documents"), model_bytes())
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"), "same")


@_query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    apart = language_id.held_out(4, 2)
    model = quality_classifier.learn(docs.where(~apart), table(spark, sf_dir, "labels").where(~apart))
    return quality_classifier.score(docs, model).select(
        "doc_id", apart.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@_query
def op9_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_shards.assign(table(spark, sf_dir, "documents"), shards=16)


@_query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


@_query
def op11_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@_query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some texts get a periodic end first, which their id decides."""
    number = F.crc32(F.col("doc_id").cast("string"))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.when((number % 10 == 0) & F.col("text").rlike(r"[^ \t-\r]"), let(
            F.struct(words().alias("words"), F.floor(number / 10).alias("g")), _with_periodic_end)).otherwise(F.col("text")).alias("text"))
    done = periodic_runs.detect(docs, least=6, times=4)
    # the first of the greatest exact exponents, as runs come by start, then period
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(
        r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return done.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(told, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def _with_periodic_end(of: Column) -> Column:
    """The words from place ``a`` on repeat the first ``p`` of them."""
    n = F.size(of["words"])

    def ended(at: Column) -> Column:
        tail = F.transform(F.sequence(at["a"], n - 1), lambda i: F.get(of["words"], (at["a"] + (i - at["a"]) % at["p"]).cast("int")))
        return F.array_join(F.concat(F.slice(of["words"], 1, at["a"]), tail), " ")

    a = (of["g"] % n).cast("int")
    return let(F.struct(a.alias("a"), (1 + F.floor((n - a) / (3 + of["g"] % 8))).cast("int").alias("p")), ended)


@_query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations begin with up to three turns of another one, which their id decides."""
    convs = prefix_trie.sequences(table(spark, sf_dir, "conversations"))
    lead = convs.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("lead"))
    taken = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    begun = F.concat(F.slice(F.coalesce("lead", F.slice("turns", 1, 0)), F.lit(1), taken),
                     F.slice("turns", taken + 1, F.size("turns")))
    rebuilt = convs.withColumn("base", F.expr("conv_id - conv_id % 20")).join(lead, "base", "left")
    return prefix_trie.nodes(rebuilt.select("conv_id", begun.alias("turns")))

"""Spreading hot keys over many tasks.

A key that holds a large share of the rows would put all of them into one task of a join.
Rows are counted per key first; keys above a fixed number of rows get parts, as many as
they need each, and the other side of the join is copied once per part. The limit does not
grow with the table. Of N rows at most N / limit keys are above it, so the list of heavy
keys is small enough to broadcast: a million rows make one entry of some 60 bytes.
Nothing is dropped: a row meets exactly the rows it would have met without parts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_ROWS = 1_000_000     # rows of a key that stay together
_SCATTER = 1 << 20       # parts for rows with a null key, which meet nothing


def heavy_keys(df: DataFrame, keys: Sequence[str], min_rows: int = MIN_ROWS) -> DataFrame:
    """``keys`` and ``_partes`` of the keys with more than ``min_rows`` rows."""
    return parts_of_heavy_keys(df.groupBy(*keys).agg(F.count("*").alias("_n")), "_n", min_rows)


def add_part(df: DataFrame, keys: Sequence[str], heavy: DataFrame, by: str) -> DataFrame:
    """Give each row the part it belongs to; ``by`` is what tells rows of a key apart."""
    alone = " or ".join(f"{k} is null" for k in keys)
    tagged = df.join(F.broadcast(heavy), list(keys), "left")
    return tagged.selectExpr(*df.columns, f"cast(pmod(xxhash64({by}), if({alone}, {_SCATTER}, coalesce(_partes, 1))) as int) as _parte")


def copy_to_parts(df: DataFrame, keys: Sequence[str], heavy: DataFrame) -> DataFrame:
    """One copy of each row per part of its key."""
    tagged = df.join(F.broadcast(heavy), list(keys), "left")
    return tagged.selectExpr(*df.columns, "explode(sequence(0, coalesce(_partes, 1) - 1)) as _parte")


def join_lookup(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, by: str,
                min_rows: int = MIN_ROWS) -> DataFrame:
    """Join ``left`` (any number of rows per key) with ``right`` (few rows per key)
    so that a hot key of ``left`` is shared by many tasks."""
    heavy = heavy_keys(left, keys, min_rows)
    spread = add_part(left, keys, heavy, by)
    copies = copy_to_parts(right, keys, heavy)
    return spread.join(copies, [*keys, "_parte"], how).drop("_parte")


def parts_of_heavy_keys(counts: DataFrame, n: str, rows_per_part: int) -> DataFrame:
    """Keys of a per-key count that need more than one part: of N rows at most
    N / rows_per_part."""
    return (counts.where(F.col(n) > rows_per_part)
            .withColumn("_partes", F.ceil(F.col(n) / rows_per_part).cast("int")).drop(n))


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], n: str, by: str,
                min_rows: int = MIN_ROWS) -> DataFrame:
    """Left join of ``rows`` with ``groups``, which has one row per key, made from ``rows``,
    and their number in ``n``. Groups of heavy keys are broadcast, and their rows are dealt
    out by a key of their own instead of going to the place of the others. The first of
    ``keys`` that is a string is what rows are dealt out by."""
    kinds = dict(rows.dtypes)
    salted = next(k for k in keys if kinds[k] == "string")
    told = [c for c in groups.columns if c not in keys]
    heavy = groups.where(F.col(n) > min_rows).select(*keys, F.struct(*told).alias("_pesado"))
    tagged = rows.join(F.broadcast(heavy), list(keys), "left")
    alone = F.col("_pesado").isNotNull() | F.col(salted).isNull()
    own = F.when(alone, F.concat(F.lit("\x01"), F.xxhash64(by).cast("string"))).otherwise(F.col(salted))
    light = groups.where(F.col(n) <= min_rows).withColumnRenamed(salted, "_chave").select(
        *[k for k in keys if k != salted], "_chave", F.struct(*told).alias("_leve"))
    joined = tagged.withColumn("_chave", own).join(light, [*[k for k in keys if k != salted], "_chave"], "left")
    return joined.select(*rows.columns, *[F.coalesce(f"_pesado.{c}", f"_leve.{c}").alias(c) for c in told])

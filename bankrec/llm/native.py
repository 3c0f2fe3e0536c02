"""SQL expressions the operators without Python share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = r"[ \t-\r]"        # [\x20\x09-\x0D]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str = "text") -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), WHITE + "+"), lambda w: w != "")


def has_word(line: Column) -> Column:
    return line.rlike(r"[^ \t-\r]")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def with_row_key(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` of each row, with a 128-bit key over both. Rows that share a
    key are equal, so whatever is found for one holds for the other."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", "text", row_key().alias("row"))


def row_key() -> Column:
    bare = F.coalesce(F.col("text"), F.lit(""))
    return F.struct(F.xxhash64(F.lit(1), "doc_id", bare, F.col("text").isNull()).alias("a"),
                    F.xxhash64(F.lit(2), bare, "doc_id").alias("b"))


def hash_limit(share: float) -> int:
    """The largest of the smallest 64-bit hashes that make up ``share`` of all."""
    return min((1 << 63) - 1, int(-(1 << 63) + min(1.0, share) * (1 << 64)))


def free_name(taken: list[str], name: str) -> str:
    """``name``, with as many underscores behind it as it takes to be new."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def packed(docs: DataFrame) -> DataFrame:
    """``all``, a struct of the columns of ``docs``, and ``key``, the ``row_key``. Columns of a
    caller cannot clash with those an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"), row_key().alias("key"))


def unpacked(columns: list[str], text: Column) -> list[Column]:
    """The columns of ``packed`` rows, with another text."""
    return [text.alias(c) if c == "text" else F.col("all")[c].alias(c) for c in columns]

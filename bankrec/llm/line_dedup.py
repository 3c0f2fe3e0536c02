"""Passages of whole lines that occurred before, found by overlapping three-line windows.

Lines with a word are hashed; each run of three neighbours is a window. Windows are grouped
by their hash over all documents, and every occurrence but the first covers its lines.
Covered positions are merged per document and removed. Only hashes are shuffled until the
texts are rebuilt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankrec.llm.native import free_name, let, packed, row_key, unpacked

_WHITE = " \t\n\x0b\x0c\r"


def _windows(docs: DataFrame, size: int) -> DataFrame:
    """``(row, id, at, lines, a, b)`` for each window of each row."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(_WHITE)).alias("x"))),
                     lambda y: y["x"] != "")
    hashed = F.transform(lines, lambda y: F.struct(
        y["i"].alias("i"), F.xxhash64(y["x"]).alias("a"),
        F.xxhash64(F.lit(1), y["x"]).alias("b")))
    rows = docs.where("text is not null").select(
        row_key().alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("id"), hashed.alias("ls"))
    parts = {k: ", ".join(f"ls[k + {j}].{k}" for j in range(size)) for k in "iab"}
    return rows.where(F.size("ls") >= size).select("row", "id", F.expr(
        f"inline(transform(sequence(0, size(ls) - {size}), k -> struct(k as at, array({parts['i']}) as lines, "
        f"xxhash64({parts['a']}) as a, xxhash64({parts['b']}) as b)))"))


def repeated_lines(docs: DataFrame, size: int = 3) -> DataFrame:
    """``(row, covered)``: for each distinct row the lines that go, as distinct positions."""
    windows = _windows(docs, size)
    first = (windows.groupBy("a", "b").agg(F.min(F.struct("id", "row", "at")).alias("first"),
                                           F.max(F.struct("id", "row", "at")).alias("last"))
             .where("first < last").drop("last"))
    later = windows.join(first, ["a", "b"]).where(F.struct("id", "row", "at") > F.col("first"))
    return (later.select("row", F.explode("lines").alias("line")).distinct()
            .groupBy("row").agg(F.collect_list("line").alias("covered")))


def remove_repeated(docs: DataFrame, size: int = 3, told: str = "n_removed") -> DataFrame:
    """The documents, all columns, without lines that are covered by a window of ``size``
    lines that occurred before, and with ``told``, the number of lines that went. Columns may
    have any names; where one is called ``told``, the number's name gets an underscore more.

    Occurrences are ordered by ``doc_id``, then by place in the text. Lines are compared
    without white space at their ends; lines without a word are not counted, and stay.
    Texts with fewer lines are not changed. A null text stays null. Rows with a null
    ``doc_id`` come last. Rows equal in ``doc_id`` and text are one document: what goes
    from one goes from all. An empty table gives an empty result.
    """
    covered = repeated_lines(docs, size).withColumnRenamed("row", "key")
    text = F.col("all.text")
    # positions that stay, by a set, so that the work is in proportion to the lines
    kept = let(F.split(text, "\n"), lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("covered")), lambda i: F.get(lines, i)), "\n"))
    left = F.when(F.col("covered").isNull(), text).otherwise(kept)
    return packed(docs).join(covered, "key", "left").select(
        *unpacked(docs.columns, left), F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias(free_name(docs.columns, told)))

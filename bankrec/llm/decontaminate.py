"""Passages of benchmark items in documents.

The items' normalised word windows form a set that is broadcast when it is small, which is
counted first; every window of every document is looked up in it, and equal strings decide.
Only hits leave the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankrec.llm.native import LOWER, UPPER, let, packed, unpacked, with_row_key

BROADCAST_WINDOWS = 1_000_000    # about 100 MB; a larger set is joined by a shuffle
_OTHER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"     # between words
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def normal_words(text: str = "text") -> Column:
    """The words of a text with A-Z as a-z; null has none."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, _OTHER + "+"), lambda w: w != "")


def _windows(all_words: Column, length: int) -> Column:
    """All runs of ``length`` words, as strings, in order; fewer words give none."""
    last = F.size(all_words) - length
    return F.transform(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")),
                       lambda i: F.array_join(F.slice(all_words, i + 1, F.lit(length)), " "))


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """``(item_id, length, gram)``: each item's windows, one window if it has fewer words."""
    found = items.select(F.col("item_id").cast("string").alias("item_id"), normal_words().alias("ws"))
    found = found.where("size(ws) > 0").withColumn("length", F.least(F.size("ws"), F.lit(window)))
    gram = F.expr("explode(transform(sequence(0, size(ws) - length), i -> array_join(slice(ws, i + 1, length), ' ')))")
    return found.select("item_id", "length", gram.alias("gram")).distinct()


def hits(docs: DataFrame, items: DataFrame, window: int = 10, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``(row, covered, item_ids)`` for each distinct row with a hit: the positions of hit
    words, ascending, and the items, sorted as strings."""
    grams = item_windows(items, window)
    known = grams.groupBy("gram", "length").agg(F.collect_set("item_id").alias("items"))
    sizes = known.groupBy("length").count().collect()        # at most ``window`` rows
    if sum(r["count"] for r in sizes) <= broadcast_windows:
        known = F.broadcast(known)
    texts = with_row_key(docs).select("row", normal_words().alias("ws"))
    found = None
    for length in sorted(r["length"] for r in sizes):
        each = texts.select("row", F.posexplode(_windows(F.col("ws"), length)).alias("at", "gram"))
        each = each.join(known.where(F.col("length") == length), "gram").select("row", "at", "length", "items")
        found = each if found is None else found.unionByName(each)
    if found is None:
        found = texts.where("false").selectExpr("row", "0 as at", "0 as length", "array('') as items")
    spots = F.expr("array_sort(array_distinct(flatten(transform(collect_set(struct(at, length)), "
                   "s -> sequence(s.at, s.at + s.length - 1)))))")
    return found.groupBy("row").agg(spots.alias("covered"), F.expr(
        "array_sort(array_distinct(flatten(collect_set(items))))").alias("item_ids"))


def report(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """One row per document row: ``doc_id``, ``n_words``, ``n_hit`` (words inside any
    occurrence of a window), ``item_ids`` and ``contaminated``.

    ``docs`` needs ``doc_id`` and ``text``, ``items`` needs ``item_id`` and ``text``; other
    columns are not read. Null and empty texts have no words and no hits; an item without
    words matches nothing; an item with a null id hits words but is not listed. Repeated
    rows come back as often as they came. Empty tables give no rows or no hits.
    """
    found = hits(docs, items, window)
    counted = with_row_key(docs).select("doc_id", "row", F.size(normal_words()).cast("long").alias("n_words"))
    return (counted.join(found, "row", "left")
            .select("doc_id", "n_words", F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
                    F.col("covered").isNotNull().alias("contaminated")))


def clean(docs: DataFrame, items: DataFrame, window: int = 10, max_hit_percent: int = 50) -> DataFrame:
    """The documents, all columns whatever their names, without hit words. A document of which
    more than ``max_hit_percent`` of the words are hit is dropped; one without hits is not
    changed. A removed word goes with the separators before it. Null and empty texts have no
    hits; rows may repeat; empty tables give no rows, or the documents as they are."""
    found = hits(docs, items, window).withColumnRenamed("row", "key").drop("item_ids")
    text = F.col("all.text")
    pieces = F.regexp_extract_all(text, F.lit(f"{_OTHER}*{_WORD}+"), F.lit(0))
    tail = F.regexp_extract(text, f"{_OTHER}*$", 0)
    # positions as a string per word: a word stays unless its position is listed
    left = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col("covered"))
    kept = let(pieces, lambda ps: F.array_join(F.transform(left, lambda i: F.get(ps, i)), ""))
    hit = 100 * F.size("covered") > max_hit_percent * F.size(pieces)
    return packed(docs).join(found, "key", "left").where(F.col("covered").isNull() | ~hit).select(
        *unpacked(docs.columns, F.when(F.col("covered").isNull(), text).otherwise(F.concat(kept, tail))))

"""Quality rules: text statistics, and lines that too many documents of a host share.

Lines are normalised and hashed; per host the distinct documents with each line are
counted. Lines above the host's limit go; a document that keeps too few of its words, or
fails the base rules, is rejected. Everything is DataFrame operations; texts stay in the
scan, and only hashes of lines are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankrec.llm.native import WHITE, has_word, let, packed, row_key, unpacked, words
from bankrec.llm.shared import stored

MIN_WORDS = 10
MAX_REPEATED = 20        # percent of the words in repeated five-word windows
LINE_DOCS = 4            # documents of a host that may share a line; on a few of them it is no boilerplate
LINE_PERCENT = 2         # nor up to this percent of the host's distinct documents,
ENOUGH_DOCS = 1000       # but on more documents than this it is, whatever the host's size
KEPT_PERCENT = 30        # of its words a document has to keep
_SYMBOLS = "[#*$%&|<>]"


def base_columns(rows: DataFrame) -> DataFrame:
    """Adds ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``
    and ``base_failed`` to rows with ``text``, which goes."""
    rest = [c for c in rows.columns if c != "text"]
    bare = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(bare, "\n"), has_word)
    split = rows.select(
        *rest, words().alias("__words"),
        F.regexp_count(bare, F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"))
    grams = F.expr("transform(if(size(__words) < 5, array(), sequence(0, size(__words) - 5)), "
                   "i -> xxhash64(__words[i], __words[i + 1], __words[i + 2], __words[i + 3], __words[i + 4]))")
    chars = F.aggregate("__words", F.lit(0).cast("long"), lambda n, w: n + F.length(w))
    counted = split.select(*rest, F.size("__words").cast("long").alias("n_words"), chars.alias("word_chars"), "n_symbols",
                           "n_dup_lines", grams.alias("__grams"))
    repeated = F.when(F.size("__grams") == F.size(F.array_distinct("__grams")), F.lit(0)).otherwise(_repeated())
    # a generator's columns are values: a later filter on them is not rewritten in terms of
    # the text, which would split it again for every window
    counted = counted.withColumn("n_repeat_words", repeated.cast("long")).select(*rest, F.inline(F.array(F.struct(
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _repeated() -> Column:
    """Words in windows whose hash stands twice in ``__grams``: sort, compare neighbours,
    add up the parts that earlier windows do not cover."""
    return F.expr("""
        aggregate(
            array_sort(transform(
                transform(array(array_sort(transform(__grams, (h, i) -> struct(h, i)))), s ->
                    filter(s, (x, k) -> (k > 0 and s[greatest(k - 1, 0)].h = x.h)
                                     or (k < size(s) - 1 and s[least(k + 1, size(s) - 1)].h = x.h)))[0],
                x -> x.i)),
            struct(0 as stop, 0 as n),
            (acc, p) -> struct(p + 5 as stop, acc.n + p + 5 - greatest(acc.stop, p) as n),
            acc -> acc.n)""")


def line_words(line: Column) -> Column:
    """A normalised line: its words in lower case. White space between them does not count."""
    return F.filter(F.split(F.lower(line), WHITE + "+"), lambda w: w != "")


def measured(docs: DataFrame) -> DataFrame:
    """A row per document row, from one scan of the texts: ``doc_id``, ``place`` (of this row
    alone), ``row`` (equal for equal rows), ``host``, ``document`` (equal for equal texts), ``lines`` (hashes and words of the
    normalised lines) and the base columns. Stored, as it is read several times."""
    lines = F.transform(F.filter(F.transform(F.split("text", "\n"), line_words), lambda ws: F.size(ws) > 0),
                        lambda ws: F.struct(F.xxhash64(ws).alias("line"), F.size(ws).alias("n")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.xxhash64(F.col("source").isNull(), F.col("source").cast("string")).alias("host"))
    return stored(base_columns(rows.withColumns({
        "place": F.monotonically_increasing_id(), "row": row_key(), "document": F.xxhash64(F.coalesce("text", F.lit(""))), "lines": lines})))


def frequent_lines(rows: DataFrame, line_docs: int, line_percent: int, enough_docs: int) -> DataFrame:
    """``(place, line, n)``: of each of the ``measured`` rows the lines above their host's limit,
    with the number of words at each occurrence. Equal texts count as one document of their host.
    A line on more than ``enough_docs`` documents is above it, whatever their share."""
    exploded = rows.select("place", "host", "document", F.explode("lines").alias("x")).select(
        "place", "host", "document", "x.line", "x.n")
    documents = exploded.select("host", "document", "line").distinct()
    sizes = rows.select("host", "document").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    counts = documents.groupBy("host", "line").agg(F.count("*").alias("shared")).where(F.col("shared") > line_docs)
    limit = (100 * F.col("shared") > line_percent * F.col("docs")) | (F.col("shared") > enough_docs)
    above = counts.join(sizes, "host").where(limit).select("host", "line")
    return exploded.join(above, ["host", "line"]).select("place", "line", "n")


def judged(docs: DataFrame, line_docs: int, line_percent: int, kept_percent: int, enough_docs: int) -> DataFrame:
    """The ``measured`` rows with ``n_line_words``, ``kept``, and as ``lines`` the frequent
    ones only, null where there is none."""
    rows = measured(docs)
    lost = (frequent_lines(rows, line_docs, line_percent, enough_docs).groupBy("place")
            .agg(F.collect_set("line").alias("lines"), F.sum("n").alias("n_line_words")))
    rows = rows.drop("lines").join(lost, "place", "left").drop("place")
    rows = rows.withColumn("n_line_words", F.coalesce("n_line_words", F.lit(0)).cast("long"))
    left = 100 * (F.col("n_words") - F.col("n_line_words"))
    return rows.withColumn("kept", ~F.col("base_failed") & (left >= kept_percent * F.col("n_words")))


def assess(docs: DataFrame, line_docs: int = LINE_DOCS, line_percent: int = LINE_PERCENT,
           kept_percent: int = KEPT_PERCENT, enough_docs: int = ENOUGH_DOCS) -> DataFrame:
    """One row per document row: ``doc_id``, the base columns, ``n_line_words`` (words in
    frequent lines) and ``kept``.

    ``docs`` needs ``doc_id``, ``text`` and ``source`` (the host); other columns are not
    read. A null text counts as empty: no words, so it fails the base rules. Rows with a
    null host are one host. Repeated rows come back as often as they came; equal texts
    count once for a line. An empty table gives no rows.

    A line is frequent on more than ``line_docs`` documents of its host that are also more
    than ``line_percent`` of them, or on more than ``enough_docs``: the host's own share
    decides at every size.
    """
    return judged(docs, line_docs, line_percent, kept_percent, enough_docs).drop("row", "host", "document", "lines")


def clean(docs: DataFrame, line_docs: int = LINE_DOCS, line_percent: int = LINE_PERCENT,
          kept_percent: int = KEPT_PERCENT, enough_docs: int = ENOUGH_DOCS) -> DataFrame:
    """The documents that ``assess`` keeps, all columns whatever their names, without their
    frequent lines; blank lines stay where they are. A document with a null text is rejected
    like an empty one; repeated rows are kept or go together; an empty table stays empty."""
    kept = judged(docs, line_docs, line_percent, kept_percent, enough_docs).where("kept").select(
        F.col("row").alias("key"), "lines").dropDuplicates(["key"])
    text = F.col("all.text")
    shorter = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("lines", F.xxhash64(line_words(x)))), "\n")
    return packed(docs).join(kept, "key").select(
        *unpacked(docs.columns, F.when(F.col("lines").isNull(), text).otherwise(shorter)))

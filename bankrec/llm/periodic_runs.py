"""Periodic runs of words, found through a recompression grammar.

A run with period ``q`` is a stretch in which words ``q`` apart are identical, at least
``max(least, times * q)`` words long and not extendable. For every period the places of a
grid are tried, so far apart that every run holds a place and the one ``q`` behind it; over
all periods that makes a harmonic sum of candidates. Where both words are the same, grammar
extensions to the right and to the left give the exact run. Multiples of a run's smallest
period find the same stretch, which is kept with the smallest.

Texts of a slice of the batch share one grammar; a word of its own stands between them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankrec.llm.recompression import Grammar
from bankrec.llm.tokens import pieces, text_buffer

LEAST, TIMES = 6, 4
_SLICE = 1 << 20      # bytes of text that share a grammar; a longer text has one of its own
_CANDIDATES = 1 << 20


def detect(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``doc_id``, ``runs`` and ``collapsed`` for each row of ``docs`` (``doc_id``, ``text``).

    ``runs`` is an array of ``(start, length, period)`` in words, by start, then period;
    ``collapsed`` is the text's words without those that some run contains after its first
    period, joined by one space. ``times`` must be 2 or more. A null or empty text, or one
    without words, has no run and an empty ``collapsed``. Rows may repeat, an empty table
    gives no rows, other columns are ignored. A text is held by one task, some hundred bytes
    a word.
    """
    if times < 2:
        raise ValueError("a run repeats its period at least twice")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shape = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return rows.mapInArrow(lambda batches: _detect(batches, least, times), shape)


def _detect(batches: Iterator[pa.RecordBatch], least: int, times: int) -> Iterator[pa.RecordBatch]:
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in batches:
        for part in pieces(batch, limit=_SLICE):
            offsets, data = text_buffer(part["text"])
            texts = [data[a:b].tobytes().split() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            first, found = runs_of(texts, least, times)
            lists = pa.ListArray.from_arrays(
                pa.array(first, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in found], fields=list(run)))
            kept = [collapsed(words, *(c[a:b] for c in found)) if b > a else b" ".join(words)
                    for words, a, b in zip(texts, first[:-1], first[1:], strict=True)]
            yield pa.record_batch([part["doc_id"], lists, pa.array(kept, pa.binary()).cast(pa.string())],
                                  names=["doc_id", "runs", "collapsed"])


def collapsed(words: list[bytes], starts: np.ndarray, lengths: np.ndarray, periods: np.ndarray) -> bytes:
    """The words that no run contains after its first period."""
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, starts + periods, 1)
    np.add.at(depth, starts + lengths, -1)
    return b" ".join(compress(words, (np.cumsum(depth[:-1]) == 0).tolist()))


def runs_of(texts: list[list[bytes]], least: int, times: int) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each text the place of its first run (and the end of all), and the starts, lengths
    and periods of all runs."""
    sizes = np.array([len(t) for t in texts], np.int64)
    number: defaultdict[bytes, int] = defaultdict(count(len(texts) + 1).__next__)
    symbols = np.empty(int(sizes.sum()) + len(texts) + 1, np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes + 1))) + 1     # of each text; what stands before is in no text
    symbols[begin - 1] = np.arange(len(texts) + 1)
    for at, words in zip(begin[:-1].tolist(), texts, strict=True):
        symbols[at:at + len(words)] = list(map(number.__getitem__, words))
    grammar = None
    found = []
    for left, period in _candidates(symbols, begin[:-1], sizes, least, times):
        grammar = grammar or Grammar(symbols)
        ahead = grammar.common(left, left + period)
        back = grammar.common(left, left + period, back=True) - 1    # the place itself counts once
        length = ahead + back + period
        true = length >= np.maximum(least, times * period)
        found.append(np.stack([left - back, length, period])[:, true])
    start, length, period = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    fresh = np.ones(len(start), bool)      # one stretch, one smallest period
    fresh[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[fresh], length[fresh], period[fresh]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    first = np.searchsorted(start, begin)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    return first, (start - begin[text], length, period)


def _candidates(symbols: np.ndarray, begin: np.ndarray, sizes: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places on the grids of all periods where the word ``period`` places behind is the same."""
    tried = np.where(sizes >= least, sizes // times, 0)         # periods of each text
    if not tried.any():
        return
    text = np.repeat(np.arange(len(sizes)), tried)
    period = np.arange(len(text)) - np.repeat(np.cumsum(tried) - tried, tried) + 1
    apart = np.maximum(least, times * period) - period
    places = (sizes[text] - period - 1) // apart + 1
    done = np.cumsum(places)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + _CANDIDATES, "right")))
        n = places[lo:hi]
        which = np.repeat(np.arange(lo, hi), n)
        step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        left = begin[text[which]] + step * apart[which]
        same = symbols[left] == symbols[left + period[which]]
        if same.any():
            yield left[same], period[which][same]
        lo = hi

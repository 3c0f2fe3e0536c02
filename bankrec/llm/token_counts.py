"""Token counts from a tokenizer compiled into a finite-state transducer.

A state of the transducer holds what the rest of a text can still depend on: the longest
end of the text read so far that begins a piece, and for each place in it where a piece may
begin, the piece before that place and the count there. A transition reads a character and
emits the change of the count. Both are compiled when first needed and kept.

A text is cut into chunks. Where a run of spaces begins, and after a line break, no piece
can reach across, so chunks there have one entry state and only their counts matter: the
counts of all texts of a batch come from one prefix sum over all their chunks. A run without
such a place is cut at a fixed length; the chunks of its text then go in sequence, each from
the state the one before left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankrec.llm.pieces import MARK, NONE, Pieces
from bankrec.llm.tokens import pieces as slices

_LONGEST_CHUNK = 200       # characters of a chunk, at most twice that with its spaces
_MAX_STATES = 300_000      # kept; compiled anew beyond
_MAX_CHUNKS = 500_000
START = 0


class Transducer:
    def __init__(self, model: bytes) -> None:
        self.pieces = Pieces(model)
        end = r"\n" if self.pieces.breaks_lines else ""
        word = f"[^ {MARK}{end}]{{1,{_LONGEST_CHUNK}}}"
        self.cut = re.compile(f"[ {MARK}]{{0,{_LONGEST_CHUNK}}}{word}|[ {MARK}]{{1,{_LONGEST_CHUNK}}}" + (r"|\n" if end else ""))
        self._reset()

    def _reset(self) -> None:
        self.states = [("", ((0, NONE, 0),))]
        self.numbers = {self.states[0]: START}
        self.moves: list[dict[str, tuple[int, int]]] = [{}]
        self.chunks: dict[str, int] = {}

    def step(self, state: int, char: str) -> tuple[int, int]:
        """The next state and the change of the count."""
        known = self.moves[state].get(char)
        if known is None:
            known = self.moves[state][char] = self._compile(state, char)
        return known

    def _compile(self, state: int, char: str) -> tuple[int, int]:
        """``live`` holds for each open beginning its distance, the piece before it, and the
        count there less the count now."""
        text, live = self.states[state]
        text += char
        ids, prefixes = self.pieces.ids, self.pieces.prefixes
        last, emitted = NONE, len(char.encode())      # no piece: one token for each byte
        for distance, before, count in live:
            piece = ids.get(text[-1 - distance:])
            if piece is not None and self.pieces.fits(before, piece):
                last, emitted = piece, count + 1
                break
        still = tuple((distance + 1, before, count - emitted) for distance, before, count in live
                      if text[-1 - distance:] in prefixes)
        open_text = text[-still[-1][0]:] if still else ""
        made = (open_text, ((0, last, 0), *still))
        number = self.numbers.get(made)
        if number is None:
            number = self.numbers[made] = len(self.states)
            self.states.append(made)
            self.moves.append({})
        return number, emitted

    def run(self, chunk: str, state: int = START) -> tuple[int, int]:
        """The chunk's map at one entry state: exit state and count."""
        total = 0
        for char in chunk.replace(" ", MARK):
            state, emitted = self.step(state, char)
            total += emitted
        return state, total

    def _fresh(self, chunk: str) -> int:
        count = self.run(chunk)[1]
        self.chunks[chunk] = count
        return count

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        if len(self.states) > _MAX_STATES:
            self._reset()
        if len(self.chunks) > _MAX_CHUNKS:
            self.chunks.clear()
        get, flat, ends = self.chunks.get, [], np.zeros(len(texts) + 1, np.int64)
        for row, text in enumerate(texts):
            if text:
                chunks = self.cut.findall(" " + text)
                if max(map(len, chunks)) < _LONGEST_CHUNK:
                    flat += [self._fresh(c) if (n := get(c)) is None else n for c in chunks]
                else:
                    flat.append(self._carried(chunks))
            ends[row + 1] = len(flat)
        sums = np.concatenate(([0], np.cumsum(np.array(flat, np.int64))))
        return sums[ends[1:]] - sums[ends[:-1]]

    def _carried(self, chunks: list[str]) -> int:
        """Chunks in sequence, where each begins in the state the one before left."""
        state, total = START, 0
        for chunk in chunks:
            state, count = self.run(chunk, state)
            total += count
            if len(self.states) > _MAX_STATES:
                kept = self.states[state]
                self._reset()
                if kept not in self.numbers:
                    self.numbers[kept] = len(self.states)
                    self.states.append(kept)
                    self.moves.append({})
                state = self.numbers[kept]
        return total


_COMPILED: dict[int, Transducer] = {}      # one for each model a Python worker has seen


def _transducer(model: bytes) -> Transducer:
    if hash(model) not in _COMPILED:
        _COMPILED[hash(model)] = Transducer(model)
    return _COMPILED[hash(model)]


def count_tokens(docs: DataFrame, model: bytes, limit: int = 4096) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens`` as the
    SentencePiece library counts them without added tokens, and ``over_limit``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. A null text counts
    as empty: no bytes, no tokens. ``doc_id`` may be null and may repeat. ``model`` is the
    content of the model file. An empty table gives no rows.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = _transducer(told.value)
        for batch in batches:
            for part in slices(batch):
                n = transducer.counts(part["text"].to_pylist())
                yield pa.record_batch([part["doc_id"], part["n_bytes"], pa.array(n, pa.int64())],
                                      names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
                       text.alias("text"))
    counted = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

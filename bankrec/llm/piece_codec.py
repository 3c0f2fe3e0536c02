"""SentencePiece encoding and decoding by shared-prefix Viterbi.

The distinct marked words of a batch that are not known yet are sorted, so that they are
the leaves of a trie in depth-first order. The forward pass goes down the trie: its state
at a depth depends on the prefix alone, so a word begins where its common prefix with the
word before ends. For a BPE model the forward pass keeps, for each place, the one piece
that ends there on a path of fitting neighbours (see ``pieces``); the path is read backwards.
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

_MAX_WORDS = 400_000       # kept; beyond, words are encoded anew


class Codec:
    def __init__(self, model: bytes) -> None:
        self.pieces = Pieces(model)
        end = r"\n" if self.pieces.breaks_lines else ""
        self.cut = re.compile(f"[ {MARK}]*[^ {MARK}{end}]+|[ {MARK}]+" + (r"|\n" if end else ""))
        self.words: dict[str, bytes] = {}

    def learn(self, words: set[str]) -> None:
        """Encode words, sharing the forward pass over common prefixes."""
        ends, known, fits = self.pieces.ends, self.pieces.known, self.pieces.fits
        before, forward = "", [(0, NONE)]       # for each place: length of the last step, piece
        for word in sorted(w.replace(" ", MARK) for w in words):
            shared = _common(before, word)
            del forward[shared + 1:]
            for place in range(shared + 1, len(word) + 1):
                # the piece that ends here after a path it fits; none for a character without a piece
                step = 1, NONE
                for start in range(place - 1, -1, -1):
                    piece = ends.get(word[start:place])
                    if piece is None:
                        break
                    if piece != NONE:
                        pair = forward[start][1], piece
                        fit = known.get(pair)
                        if fits(*pair) if fit is None else fit:
                            step = place - start, piece
                            break
                forward.append(step)
            self.words[word] = self._path(word, forward)
            before = word

    def _path(self, word: str, forward: list[tuple[int, int]]) -> bytes:
        ids, place = [], len(word)
        while place:
            length, piece = forward[place]
            if piece == NONE:
                ids.extend(self.pieces.byte_ids[b] for b in reversed(word[place - 1].encode()))
            else:
                ids.append(piece)
            place -= length
        return np.array(ids[::-1], "<i4").tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        cut = [None if t is None else [w.replace(" ", MARK) for w in self.cut.findall(" " + t)] if t else [] for t in texts]
        new = {w for words in cut if words for w in words}.difference(self.words)
        if len(self.words) + len(new) > _MAX_WORDS:
            self.words.clear()
            new = {w for words in cut if words for w in words}
        self.learn(new)
        get = self.words.__getitem__
        return [None if words is None else np.frombuffer(b"".join(map(get, words)), "<i4") for words in cut]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.pieces.surfaces.__getitem__, ids.tolist())).decode(errors="replace")
        return text[1:] if text[:1] == " " else text      # the space that encoding puts first


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


_CODECS: dict[int, Codec] = {}


def _codec(model: bytes) -> Codec:
    if hash(model) not in _CODECS:
        _CODECS[hash(model)] = Codec(model)
    return _CODECS[hash(model)]


def encode(docs: DataFrame, model: bytes, column: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` in ``column``, which takes the place of a
    column of that name: those of the SentencePiece library, without added tokens.

    A null text gives null, an empty one an empty list. Other columns, null or not, pass
    unchanged, and rows may repeat. ``model`` is the content of the model file. An empty
    table gives no rows.
    """
    told = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.drop(column) if column in docs.columns else docs
    names = [*plain.columns, column]
    at = plain.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(told.value)
        for batch in batches:
            for part in slices(batch):
                found = codec.encode(part.column(at).to_pylist())
                yield pa.record_batch([*part.columns, _lists(found)], names=names)

    return plain.mapInArrow(run, _with(plain, column, "array<int>"))


def decode(docs: DataFrame, model: bytes, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """``docs`` with the text of the token ids in ``column``. A null list gives null."""
    told = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.drop(column) if column in docs.columns else docs
    names = [*plain.columns, column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(told.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                lists = part[ids]
                texts = [codec.decode(np.asarray(lists[i].values)) if lists[i].is_valid else None
                         for i in range(len(lists))]
                yield pa.record_batch([*part.columns, pa.array(texts, pa.string())], names=names)

    return plain.mapInArrow(run, _with(plain, column, "string"))


def _lists(found: list[np.ndarray | None]) -> pa.Array:
    sizes = np.array([0 if f is None else len(f) for f in found], np.int64)
    values = np.concatenate([f for f in found if f is not None] or [np.empty(0, np.int32)])
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    missing = pa.array([f is None for f in found])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()), mask=missing)


def _with(docs: DataFrame, column: str, kind: str):
    from pyspark.sql import types as T

    return T.StructType([*docs.schema.fields, *T.StructType.fromDDL(f"`{column}` {kind}").fields])


def round_trip(docs: DataFrame, model: bytes) -> DataFrame:
    """``doc_id``, ``ids``, ``decoded`` and ``same`` (the text came back; null for null).
    Only the mark character itself does not come back: it reads as a space."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    back = decode(encode(rows, model), model)
    return back.select("doc_id", "ids", "decoded", (F.col("decoded") == F.col("text")).alias("same"))

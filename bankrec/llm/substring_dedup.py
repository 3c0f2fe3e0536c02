"""Repeated passages, found through difference-cover anchors.

A set D of residues modulo M is a difference cover when every difference modulo M is the
difference of two of its members. Short windows of ``window - M + 1`` words are hashed at
positions whose residue lies in D only (3 of 7). Two equal long windows, wherever they
stand in their texts, then share an anchor at the same offset, so

1. anchors that occur in more than one document are found;
2. around these, and nowhere else, anchors are extended to whole windows; and
3. of each such window the smallest document is found; later ones lose the words.

Documents are dealt into chunks of about ``chunk_bytes`` by a hash of their id; rows without
id are in no group. A chunk sends its distinct hashes, sorted and packed, to hash buckets and gets one bit for each
back: an anchor or passage that every document shares costs one entry per chunk, and
answers cost a bit. Chunks and buckets are the only groups; both have a bounded size, but for
a chunk in which one id has many rows: these are one document, and stay together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bankrec.llm.tokens import WHITE, Words, pieces, whole_windows, windows, words_of

MODULUS = 7
COVER = (0, 1, 3)          # every difference modulo 7 occurs: a perfect difference set
CHUNK_BYTES = 4 << 20
BUCKET_ENTRIES = 500_000
_ANCHOR_BYTES = 6          # a prefix of the hash; anchors only choose candidates
_KEY_BYTES = 10            # 80 bits decide equality of windows

_PACKED = "bucket long, chunk long, keys binary, ids binary"
_BITS = "chunk long, phase int, bucket long, bits binary"
_RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"


def remove_repeated(docs: DataFrame, window: int = 13, chunk_bytes: int = CHUNK_BYTES,
                    bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """Remove each word covered by a ``window``-word window that also starts in a document
    with a smaller ``doc_id``; windows are judged on the input.

    ``docs`` needs ``doc_id`` and ``text``; other columns, whatever their names, are not
    read. Returns one row per input row: ``doc_id``, ``n_words``, ``n_removed``, ``spans``
    (removed runs of words, end exclusive) and ``kept`` (remaining words joined by one
    space). A null or empty text has no words, and ``kept`` is empty. Rows with a null
    ``doc_id`` come back whole and remove nothing elsewhere. Rows that repeat a ``doc_id``
    are one document: they do not remove each other's words. An empty table gives an
    empty result.
    """
    if window < MODULUS + 1:
        raise ValueError(f"windows of {MODULUS + 1} words at least")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, unnamed = rows.where("doc_id is not null"), rows.where("doc_id is null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, math.ceil(total / chunk_bytes))
    buckets = 1 << max(0, math.ceil(math.log2(max(1.0, total / 12 / bucket_entries))))
    plan = _Plan(window, buckets)   # Spark tells functions apart by their arguments, hence the lambdas
    dealt = rows.withColumn("chunk", _chunk(chunks)).select("chunk", "doc_id", "text")
    groups = dealt.groupBy("chunk")

    shared = (groups.applyInArrow(lambda part: plan.anchors(part), _PACKED)
              .groupBy("bucket").applyInArrow(_shared_bits, _BITS))
    earlier = (groups.cogroup(shared.groupBy("chunk"))
               .applyInArrow(lambda part, answers: plan.candidates(part, answers), _PACKED)
               .groupBy("bucket").applyInArrow(_earlier_bits, _BITS))
    done = (groups.cogroup(shared.unionByName(earlier).groupBy("chunk"))
            .applyInArrow(lambda part, answers: plan.result(part, answers), _RESULT))
    return done.unionByName(unnamed.mapInArrow(_whole, _RESULT))


def _chunk(chunks: int) -> Column:
    return F.expr(f"pmod(xxhash64(doc_id), {chunks}L)")


class _Chunk:
    """The words of a chunk, its anchors and the windows around shared anchors."""

    def __init__(self, rows: pa.Table, window: int) -> None:
        self.number = rows["chunk"][0].as_py()
        ids = rows["doc_id"].combine_chunks()
        self.ids = np.asarray(ids).astype(np.int64)
        self.words: Words = words_of(rows["text"])
        self.window = window
        short = window - MODULUS + 1
        cover = np.isin(np.arange(MODULUS), COVER)
        n = max(0, len(self.words.doc) - short + 1)
        fit = whole_windows(self.words, short) & cover[self.words.position()[:n] % MODULUS]
        self.at = np.flatnonzero(fit)
        keys = windows(self.words.hashes, short)[self.at] >> np.uint64(64 - 8 * _ANCHOR_BYTES)
        self.distinct, self.which = np.unique(keys, return_inverse=True)

    def shared_here(self) -> np.ndarray:
        """Which distinct anchors stand in two documents of this chunk."""
        owner = self.ids[self.words.doc[self.at]]
        low, high = np.full(len(self.distinct), np.iinfo(np.int64).max), np.full(len(self.distinct), np.iinfo(np.int64).min)
        np.minimum.at(low, self.which, owner)
        np.maximum.at(high, self.which, owner)
        return low < high

    def extend(self, shared: np.ndarray) -> None:
        """Windows with a shared anchor, and for each distinct one its smallest document."""
        total = len(self.words.doc)
        marks = np.zeros(total + MODULUS + 1, np.int64)
        marks[self.at[shared[self.which]] + 1] = 1
        marks = np.cumsum(marks)
        n = max(0, total - self.window + 1)
        near = (marks[MODULUS:MODULUS + n] - marks[:n]) > 0
        self.windows = np.flatnonzero(near & whole_windows(self.words, self.window))
        high = windows(self.words.hashes, self.window, 1)[self.windows]
        low = (windows(self.words.hashes, self.window, 2)[self.windows] >> np.uint64(48)).astype(np.uint16)
        owner = self.ids[self.words.doc[self.windows]]
        order = np.lexsort((owner, low, high))
        new = np.ones(len(order), bool)
        new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        self.key_of = np.empty(len(order), np.int64)
        self.key_of[order] = np.cumsum(new) - 1
        head = order[new]
        self.high, self.low, self.least, self.owner = high[head], low[head], owner[head], owner

    def covered(self, earlier: np.ndarray) -> np.ndarray:
        """Words in a window that also starts in a smaller document."""
        repeated = (self.owner > self.least[self.key_of]) | earlier[self.key_of]
        steps = np.zeros(len(self.words.doc) + 1, np.int64)
        np.add.at(steps, self.windows[repeated], 1)
        np.add.at(steps, self.windows[repeated] + self.window, -1)
        return np.cumsum(steps)[:-1] > 0


class _Plan:
    """What the tasks need to know besides their rows."""

    def __init__(self, window: int, buckets: int) -> None:
        self.window, self.buckets = window, buckets

    def _bounds(self, sorted_keys: np.ndarray, bits: int) -> np.ndarray:
        """Where each bucket begins among sorted keys of so many bits."""
        width = int(math.log2(self.buckets))
        marks = (sorted_keys >> np.uint64(bits - width)) if width else np.zeros(len(sorted_keys), np.uint64)
        return np.searchsorted(marks, np.arange(self.buckets + 1, dtype=np.uint64))

    def _packed(self, chunk: _Chunk, bounds: np.ndarray, keys: np.ndarray, ids: np.ndarray | None) -> pa.Table:
        filled = np.flatnonzero(bounds[1:] > bounds[:-1])
        return pa.table({
            "bucket": pa.array(filled, pa.int64()),
            "chunk": pa.array(np.full(len(filled), chunk.number), pa.int64()),
            "keys": pa.array([keys[bounds[b]:bounds[b + 1]].tobytes() for b in filled], pa.binary()),
            "ids": pa.array([_pack_ids(ids[bounds[b]:bounds[b + 1]]) if ids is not None else None
                             for b in filled], pa.binary())})

    def _bits(self, answers: pa.Table, phase: int, bounds: np.ndarray) -> np.ndarray:
        out = np.zeros(int(bounds[-1]), bool)
        for kind, bucket, bits in zip(*(answers[c].to_pylist() for c in ("phase", "bucket", "bits")), strict=True):
            if kind == phase:
                lo, hi = int(bounds[bucket]), int(bounds[bucket + 1])
                out[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo)
        return out

    def anchors(self, rows: pa.Table) -> pa.Table:
        chunk = _Chunk(rows, self.window)
        bounds = self._bounds(chunk.distinct, 8 * _ANCHOR_BYTES)
        return self._packed(chunk, bounds, _pack(chunk.distinct, _ANCHOR_BYTES), None)

    def _extended(self, rows: pa.Table, answers: pa.Table) -> _Chunk:
        chunk = _Chunk(rows, self.window)
        bounds = self._bounds(chunk.distinct, 8 * _ANCHOR_BYTES)
        chunk.extend(self._bits(answers, 1, bounds) | chunk.shared_here())
        return chunk

    def candidates(self, rows: pa.Table, answers: pa.Table) -> pa.Table:
        if rows.num_rows == 0:
            return _empty(_PACKED_ARROW)
        chunk = self._extended(rows, answers)
        keys = np.concatenate([_pack(chunk.high, 8), _pack(chunk.low.astype(np.uint64), _KEY_BYTES - 8)], axis=1)
        return self._packed(chunk, self._bounds(chunk.high, 64), keys, chunk.least)

    def result(self, rows: pa.Table, answers: pa.Table) -> pa.Table:
        if rows.num_rows == 0:
            return _empty(_RESULT_ARROW)
        chunk = self._extended(rows, answers)
        return _kept(rows, chunk.words, chunk.covered(self._bits(answers, 2, self._bounds(chunk.high, 64))))


def _pack(values: np.ndarray, size: int) -> np.ndarray:
    """The low bytes of 64-bit values, one row each."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size])


def _pack_ids(ids: np.ndarray) -> bytes:
    """The smallest id, then the distances from it in as few bytes as hold them."""
    base = int(ids.min())
    away = ids.astype(np.uint64) - np.uint64(base % (1 << 64))
    kind = next(k for k in ("<u2", "<u4", "<u8") if int(away.max()) <= np.iinfo(k).max)
    return np.array([base], "<i8").tobytes() + away.astype(kind).tobytes()


def _unpack_ids(raw: bytes, n: int) -> np.ndarray:
    base = np.frombuffer(raw[:8], "<i8").astype(np.uint64)
    return (np.frombuffer(raw[8:], f"<u{(len(raw) - 8) // n}").astype(np.uint64) + base).astype(np.int64)


def _unpack(raw: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``size`` bytes, and which entry each came from."""
    rows = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, size)
    return rows, np.repeat(np.arange(len(raw)), [len(r) // size for r in raw])


def _number(rows: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(rows), 8), np.uint8)
    wide[:, :rows.shape[1]] = rows
    return wide.view("<u8").ravel()


def _answers(rows: pa.Table, phase: int, marks: np.ndarray, source: np.ndarray) -> pa.Table:
    cuts = np.searchsorted(source, np.arange(rows.num_rows + 1))
    return pa.table({
        "chunk": rows["chunk"], "phase": pa.array(np.full(rows.num_rows, phase), pa.int32()), "bucket": rows["bucket"],
        "bits": pa.array([np.packbits(marks[a:b]).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())})


def _shared_bits(rows: pa.Table) -> pa.Table:
    """Anchors of a bucket that came from more than one chunk."""
    packed, source = _unpack(rows["keys"].to_pylist(), _ANCHOR_BYTES)
    keys = _number(packed)
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    marks = np.zeros(len(keys), bool)
    marks[order[1:][same]] = True
    marks[order[:-1][same]] = True
    return _answers(rows, 1, marks, source)


def _earlier_bits(rows: pa.Table) -> pa.Table:
    """Windows of a bucket for which another chunk has a smaller document."""
    packed, source = _unpack(rows["keys"].to_pylist(), _KEY_BYTES)
    counts = np.bincount(source, minlength=rows.num_rows)
    ids = np.concatenate([_unpack_ids(raw, n) for raw, n in zip(rows["ids"].to_pylist(), counts, strict=True)])
    high, low = _number(packed[:, :8]), _number(packed[:, 8:])
    order = np.lexsort((ids, low, high))
    new = np.ones(len(order), bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    least = ids[order][new][np.cumsum(new) - 1]
    marks = np.empty(len(order), bool)
    marks[order] = ids[order] > least
    return _answers(rows, 2, marks, source)


_PACKED_ARROW = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary())])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                           ("spans", _SPANS), ("kept", pa.string())])


def _empty(schema: pa.Schema) -> pa.Table:
    return schema.empty_table()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Result rows that keep all their words."""
    for batch in batches:
        for part in pieces(batch):
            words = words_of(part["text"])
            yield from _kept(pa.Table.from_batches([part]), words, np.zeros(len(words.doc), bool)).to_batches()


def _kept(rows: pa.Table, words: Words, removed: np.ndarray) -> pa.Table:
    """Result rows: counts, spans and the words that stay, joined by one space."""
    n = rows.num_rows
    stay = ~removed
    # the bytes of each kept word and the white space after it, which becomes one space
    steps = np.zeros(len(words.data) + 2, np.int8)
    steps[words.starts[stay]] += 1
    steps[words.ends[stay] + 1] -= 1
    take = np.cumsum(steps, dtype=np.int8)[:len(words.data)] > 0
    data = words.data.copy()
    gaps = words.ends[words.ends < len(data)]
    gaps = gaps[np.isin(data[gaps], list(WHITE))]
    data[gaps] = 32
    out = data[take].tobytes()
    bound = np.concatenate(([0], np.cumsum(take)))
    count = np.diff(words.first)
    gone = np.bincount(words.doc[removed], minlength=n)
    marks = np.concatenate(([0], removed * (words.doc + 1), [0]))   # runs end where texts end
    edges = np.flatnonzero(np.diff(marks))
    texts, spans = [], [[] for _ in range(n)]
    for lo, hi in zip(edges, edges[1:], strict=False):
        if marks[lo + 1]:
            row = int(words.doc[lo])
            spans[row].append({"start": int(lo - words.first[row]), "end": int(hi - words.first[row])})
    for row in range(n):
        a, b = words.first[row], words.first[row + 1]
        if count[row] == gone[row]:
            texts.append("")
            continue
        begin, last = a + int(np.argmax(stay[a:b])), b - 1 - int(np.argmax(stay[a:b][::-1]))
        texts.append(out[bound[words.starts[begin]]:bound[words.ends[last]]].decode())
    return pa.table([rows["doc_id"].combine_chunks().cast(pa.int64()), pa.array(count, pa.int64()),
                     pa.array(gone, pa.int64()), pa.array(spans, _SPANS), pa.array(texts, pa.string())],
                    schema=_RESULT_ARROW)

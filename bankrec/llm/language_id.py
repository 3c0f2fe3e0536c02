"""Language of texts by a byte convolutional network.

Bytes are embedded, filters of several widths run over a window, each filter keeps its
largest value in the window, and a softmax over the languages follows. The network is
trained in numpy with Adam on windows of a bounded sample of labelled texts, and applied
to every window of fixed length of every text; windows are averaged by their letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bankrec.llm.native import hash_limit
from bankrec.llm.tokens import text_buffer
from bankrec.llm.tokens import pieces as slices

SAMPLE_TEXTS = 1500      # for each language, at most
TOTAL_TEXTS = 300_000    # of all languages; with many, each has fewer texts, but one at least
WINDOW = 256             # bytes
WIDTHS, FILTERS, EMBEDDED = (2, 3, 4), 16, 8
EPOCHS, BATCH, RATE = 6, 64, 0.01
UNKNOWN = "und"


@dataclass
class Network:
    labels: list[str]
    embedding: np.ndarray            # 256 x EMBEDDED
    filters: list[np.ndarray]        # for each width: width * EMBEDDED x FILTERS
    shifts: list[np.ndarray]
    out: np.ndarray                  # len(WIDTHS) * FILTERS x labels
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.shifts, self.out, self.bias]

    def tables(self) -> list[tuple[list[np.ndarray], np.ndarray]]:
        """What each byte, or pair of bytes, adds to the filters at its place in them."""
        out = []
        for width, weights, shift in zip(WIDTHS, self.filters, self.shifts, strict=True):
            single = [self.embedding @ weights[k * EMBEDDED:(k + 1) * EMBEDDED] for k in range(width)]
            pairs = [(single[k][:, None] + single[k + 1][None]).reshape(-1, FILTERS).astype(np.float32)
                     for k in range(0, width - 1, 2)]
            if width % 2:
                pairs.append(single[-1].astype(np.float32))
            out.append((pairs, shift.astype(np.float32)))
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, targets: np.ndarray, labels: list[str], seed: int = 7) -> Network:
    """Fit the network to windows (rows of bytes) and label numbers."""
    rng = np.random.default_rng(seed)
    net = Network(labels, rng.normal(0, 0.3, (256, EMBEDDED)),
                  [rng.normal(0, (2 / (w * EMBEDDED)) ** 0.5, (w * EMBEDDED, FILTERS)) for w in WIDTHS],
                  [np.zeros(FILTERS) for _ in WIDTHS],
                  rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels))), np.zeros(len(labels)))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    weight = 1 / np.maximum(1, np.bincount(targets, minlength=len(labels)))
    weight *= len(labels) / max(1, np.count_nonzero(np.bincount(targets, minlength=len(labels)))) / weight.mean()
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), BATCH):
            step += 1
            some = order[lo:lo + BATCH]
            grads = _gradients(net, windows[some], targets[some], np.minimum(weight[targets[some]], 10))
            for p, g, (m, v) in zip(net.parameters(), grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return net


def _gradients(net: Network, rows: np.ndarray, targets: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    n = len(rows)
    embedded = net.embedding[rows]
    kept, places, columns = [], [], []
    for width, weights, shift in zip(WIDTHS, net.filters, net.shifts, strict=True):
        view = np.lib.stride_tricks.sliding_window_view(embedded, width, axis=1)   # n, places, EMBEDDED, width
        flat = view.transpose(0, 1, 3, 2).reshape(n, -1, width * EMBEDDED)
        values = flat @ weights + shift
        at = values.argmax(axis=1)
        best = np.take_along_axis(values, at[:, None], axis=1)[:, 0]
        kept.append(np.maximum(best, 0))
        places.append(at)
        columns.append(flat)
    hidden = np.concatenate(kept, axis=1)
    error = _softmax(hidden @ net.out + net.bias)
    error[np.arange(n), targets] -= 1
    error *= weight[:, None] / n
    back = error @ net.out.T
    d_embedding, d_filters, d_shifts = np.zeros_like(net.embedding), [], []
    for k, (width, weights) in enumerate(zip(WIDTHS, net.filters, strict=True)):
        part = back[:, k * FILTERS:(k + 1) * FILTERS] * (kept[k] > 0)
        inputs = np.take_along_axis(columns[k], places[k][:, :, None], axis=1)      # n, FILTERS, width * EMBEDDED
        d_filters.append(np.einsum("nfe,nf->ef", inputs, part))
        d_shifts.append(part.sum(axis=0))
        spread = (part[:, :, None] * weights.T[None]).reshape(n, FILTERS, width, EMBEDDED)
        for j in range(width):
            seen = np.take_along_axis(rows, places[k] + j, axis=1)
            np.add.at(d_embedding, seen.ravel(), spread[:, :, j].reshape(-1, EMBEDDED))
    return [d_embedding, *d_filters, *d_shifts, hidden.T @ error, error.sum(axis=0)]


def _to_windows(data: np.ndarray) -> np.ndarray:
    """All bytes of a text in rows of WINDOW bytes; the last row is filled up with zeros."""
    rows = max(1, -(-len(data) // WINDOW))
    out = np.zeros((rows, WINDOW), np.uint8)
    out.ravel()[:len(data)] = data
    return out


class Scorer:
    def __init__(self, net: Network) -> None:
        self.net, self.tables = net, net.tables()

    def windows(self, rows: np.ndarray) -> np.ndarray:
        """Probabilities of the languages for rows of bytes, some rows at a time."""
        return np.concatenate([self._some(rows[lo:lo + 256]) for lo in range(0, len(rows), 256)])

    def _some(self, rows: np.ndarray) -> np.ndarray:
        pairs = rows[:, :-1].astype(np.int32) * 256 + rows[:, 1:]
        hidden = []
        for width, (tables, shift) in zip(WIDTHS, self.tables, strict=True):
            n = WINDOW - width + 1
            values = tables[0][pairs[:, :n]]
            for k, table in enumerate(tables[1:], 1):
                values += table[pairs[:, 2 * k:2 * k + n]] if len(table) > 256 else table[rows[:, 2 * k:2 * k + n]]
            hidden.append(np.maximum(values.max(axis=1) + shift, 0))
        return _softmax(np.concatenate(hidden, axis=1) @ self.net.out + self.net.bias)

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text the label number and its probability."""
        offsets, data = text_buffer(column)
        rows = [_to_windows(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        counts = np.array([len(r) for r in rows])
        flat = np.concatenate(rows)
        letters = _LETTERS[flat].sum(axis=1) + 1e-6
        shares = self.windows(flat) * letters[:, None]
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        total = np.add.reduceat(shares, starts) / np.add.reduceat(letters, starts)[:, None]
        best = total.argmax(axis=1)
        return best, np.clip(total[np.arange(len(best)), best], 0, 1)


_LETTERS = np.array([(65 <= b <= 90) or (97 <= b <= 122) or b >= 128 for b in range(256)], float)


def held_out(modulus: int, remainder: int) -> Column:
    """Documents that nothing is learned from; one without id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def learn(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS, seed: int = 7, total_texts: int = TOTAL_TEXTS) -> Network | None:
    """Train on ``docs`` with ``text`` and ``lang``; null where there is nothing to learn.
    Repeated rows count once. As many languages as there are come to the driver, by name.

    Every language is learned. The sample is bounded: ``sample_texts`` texts of each
    language, or an equal part of ``total_texts`` where that is less (one text at least),
    those with the smallest hash, and of each text one window at a hashed place."""
    rows = docs.where("lang is not null and text rlike '\\\\p{L}'").select("lang", "text")
    different = F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n")
    counts = {r["lang"]: max(1, r["n"]) for r in rows.groupBy("lang").agg(different).collect()}
    labels = sorted(counts)
    if not labels:
        return None
    each = max(1, min(sample_texts, total_texts // len(labels)))
    start = F.expr(f"1 + pmod(xxhash64(text, 3), greatest(1, char_length(text) - {WINDOW // 2}))").cast("int")
    # a hash decides before the shuffle, so that a frequent language sends little more than its sample
    some = 1.1 * each + 4 * each ** 0.5 + 10
    limits = docs.sparkSession.createDataFrame(
        [(k, hash_limit(some / n)) for k, n in counts.items()], "lang string, most long")
    order = W.partitionBy("lang").orderBy("place", "part")
    taken = (rows.select("lang", F.substring(F.col("text"), start, F.lit(WINDOW)).alias("part"), F.xxhash64("text").alias("place"))
             .join(F.broadcast(limits), "lang").where("place <= most").select("lang", "part", "place").distinct()
             .withColumn("n", F.row_number().over(order)).where(F.col("n") <= each))
    sample = sorted((r["lang"], r["place"], r["part"]) for r in taken.collect())
    number = {label: k for k, label in enumerate(labels)}
    windows = np.stack([_to_windows(np.frombuffer(part.encode()[:WINDOW], np.uint8))[0] for _, _, part in sample])
    return train(windows, np.array([number[lang] for lang, _, _ in sample]), labels, seed)


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` for each row. Only ``text`` is looked at; a
    null text, one without a letter, and any text where nothing was learned, is ``und``
    with score 0. Every window of a text counts. Rows may repeat; an empty table gives no
    rows."""
    told = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(told.value) if told.value else None
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                if scorer is None:
                    names, scores = [None] * part.num_rows, np.zeros(part.num_rows)
                else:
                    best, scores = scorer.texts(part["text"])
                    names = [scorer.net.labels[b] for b in best]
                yield pa.record_batch([part["doc_id"], pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                                       part["letter"]], names=["doc_id", "lang_pred", "score", "letter"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                       F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    scored = rows.mapInArrow(run, "doc_id long, lang_pred string, score double, letter boolean")
    known = F.col("letter") & F.col("lang_pred").isNotNull()
    return scored.select("doc_id", F.when(known, F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
                         F.when(known, F.col("score")).otherwise(0.0).alias("score"))

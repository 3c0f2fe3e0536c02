"""Quality scores by naive Bayes support vectors.

A text is the set of its n-grams, hashed. A bounded number of labelled texts counts for the
log-ratios of the classes; a linear hinge-loss model is fitted to the indicators scaled by these ratios,
by dual coordinate descent over a part of them. Margins of texts kept out of the fit turn
into probabilities through a logistic curve. N-grams are runs of bytes, and runs of marks
at words and lines that repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankrec.llm.native import hash_limit
from bankrec.llm.shared import stored
from bankrec.llm.tokens import mix, text_buffer
from bankrec.llm.tokens import pieces as slices

BITS = 16                 # 65,536 features
COUNTED_TEXTS = 30_000    # labelled ids that the ratios are counted over, about
SAMPLE_TEXTS = 6000       # labelled texts the support vectors are fitted to, at most,
SAMPLE_FEATURES = 24_000_000   # with as many features in all
SMOOTHING, COST, PASSES = 1.0, 1.0, 12
_TOLD = "kind int, place long, found binary, n long"
_SPAN = 1 << 20           # bytes of a text looked at together; spans overlap


@dataclass
class Model:
    weights: np.ndarray
    shift: float
    slope: float
    middle: float

    def score(self, found: np.ndarray) -> float:
        margin = (self.weights[found].sum() / max(1.0, len(found)) ** 0.5) + self.shift
        return float(1 / (1 + np.exp(-np.clip(self.slope * (margin - self.middle), -30, 30))))


def features(text: np.ndarray) -> np.ndarray:
    """The distinct hashed n-grams of a text's bytes, ascending."""
    seen = np.zeros(1 << BITS, bool)
    for lo in range(0, len(text), _SPAN):
        data = text[lo:lo + _SPAN + 3].astype(np.uint64)
        for size in (1, 2, 3, 4):
            n = len(data) - size + 1
            if n > 0:
                code = np.full(n, size, np.uint64)
                for k in range(size):
                    code = (code << np.uint64(8)) | data[k:k + n]
                seen[(code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)] = True
    for code in repeat_grams(text.tobytes()):
        seen[mix(np.array([code], np.uint64))[0] >> np.uint64(64 - BITS)] = True
    return np.flatnonzero(seen).astype(np.uint16)


def repeat_grams(text: bytes) -> list[int]:
    """Runs of marks, as numbers: words equal to the word before, and lines (with a word)
    that the text has had. Only runs of repeats are told: up to four, and by their share."""
    words = text.split()
    lines = [x for x in map(bytes.strip, text.split(b"\n")) if x]
    known: set[bytes] = set()
    again = bytes(x in known or known.add(x) is not None for x in lines)
    out = []
    for kind, marks in ((1 << 40, bytes(map(eq, words, words[1:]))), (2 << 40, again)):
        out += [kind + size for size in range(1, 5) if b"\x01" * size in marks]
        share = 10 * sum(marks) // max(1, len(marks))
        out += [kind + 100 + k for k in range(1, share + 1)]
    return out


def fit(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, seed: int = 7) -> Model:
    """Dual coordinate descent on scaled indicators; one text in four is kept out for the curve."""
    rng = np.random.default_rng(seed)
    out = rng.random(len(rows)) < 0.25
    signs = np.where(labels == 1, 1.0, -1.0)
    # classes weigh alike, or the rarer one would hardly count
    share = np.array([max(1, int((labels == k).sum())) for k in (0, 1)])
    cost = COST * len(labels) / 2 / share[labels]
    values = [ratios[r] / max(1.0, len(r)) ** 0.5 for r in rows]
    norms = np.array([v @ v + 1.0 for v in values])
    weights, shift = np.zeros(len(ratios)), 0.0
    alpha = np.zeros(len(rows))
    inside = np.flatnonzero(~out)
    for _ in range(PASSES):
        for i in rng.permutation(inside):
            gradient = signs[i] * (weights[rows[i]] @ values[i] + shift) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            if new != alpha[i]:
                move = (new - alpha[i]) * signs[i]
                weights[rows[i]] += move * values[i]
                shift += move
                alpha[i] = new
    model = Model(weights * ratios, shift, 1.0, 0.0)
    kept = np.flatnonzero(out) if len(set(labels[out])) == 2 else np.arange(len(rows))
    margins = np.array([values[i] @ weights[rows[i]] + shift for i in kept])
    model.slope, model.middle = _curve(margins, labels[kept])
    return model


def _curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and middle of the logistic curve, by Newton steps with slightly softened labels."""
    ones, zeros = labels.sum(), (labels == 0).sum()
    goal = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        error, w = p - goal, np.maximum(p * (1 - p), 1e-6)
        grad = np.array([error @ margins + 1e-3 * a, error.sum()])
        hess = np.array([[w @ (margins * margins) + 1e-3, w @ margins], [w @ margins, w.sum() + 1e-6]])
        move = np.linalg.solve(hess, grad)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-8:
            break
    a = max(a, 1e-3)
    return float(a), float(-b / a)


def learn(docs: DataFrame, labels: DataFrame, sample_texts: int = SAMPLE_TEXTS, seed: int = 7,
          counted_texts: int = COUNTED_TEXTS, sample_features: int = SAMPLE_FEATURES) -> Model | None:
    """Learn from ``docs`` (``doc_id``, ``text``) and ``labels`` (``doc_id``, ``quality``); null
    where either class is missing. Rows without id or text, and labels other than 0 and 1,
    are left out; of several labels of an id the greatest counts; repeated rows count each.

    About ``counted_texts`` labelled ids, those with the smallest hash, give the ratios, and of
    their texts ``sample_texts`` fit the support vectors, as long as they have no more than
    ``sample_features`` features in all. The chosen labels are few, so no text is shuffled."""
    marked = stored(labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
                    .agg(F.max("quality").cast("int").alias("quality")))
    total = max(1, marked.count())
    chosen = marked.where(F.xxhash64("doc_id") <= hash_limit(counted_texts / total))
    rows = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "text", "quality", F.xxhash64("doc_id", "text").alias("place"))
    cutoff = hash_limit(1.3 * sample_texts / min(counted_texts, total))
    told = stored(rows.mapInArrow(lambda batches: _tell(batches, cutoff), _TOLD))
    counts = told.where("kind >= 2").repartition("kind").mapInArrow(_add, _TOLD)
    summed = {r["kind"]: (np.frombuffer(r["found"], "<i8"), r["n"]) for r in counts.collect()}
    if {2, 3} - summed.keys():
        return None
    scaled = []
    for kind in (3, 2):
        n, texts = summed[kind]
        scaled.append(np.log((n + SMOOTHING) / (texts + 2 * SMOOTHING)))
    sample = told.where("kind < 2").dropDuplicates(["place", "kind"])
    order = sample.select("place", "kind", "n").orderBy("place", "kind").limit(sample_texts).collect()
    within = np.cumsum([r["n"] for r in order]) <= sample_features
    if not within.any():
        return None
    last = order[int(within.sum()) - 1]
    picked = sample.where((F.col("place") < last["place"]) | ((F.col("place") == last["place"]) & (F.col("kind") <= last["kind"])))
    picked = sorted((r["place"], r["kind"], bytes(r["found"])) for r in picked.select("place", "kind", "found").collect())
    targets = np.array([kind for _, kind, _ in picked])
    if len(set(targets.tolist())) < 2:
        return None
    return fit([np.frombuffer(found, "<u2") for *_, found in picked], targets, scaled[0] - scaled[1], seed)


def _tell(batches: Iterator[pa.RecordBatch], cutoff: int) -> Iterator[pa.RecordBatch]:
    """Features of the sampled texts (kind: label), and at the end how many texts of each
    class have each feature (kind: label + 2)."""
    counts, texts = np.zeros((2, 1 << BITS), np.int64), [0, 0]
    for batch in batches:
        for part in slices(batch):
            offsets, data = text_buffer(part["text"])
            out = []
            for row, (label, place) in enumerate(zip(part["quality"].to_pylist(), part["place"].to_pylist(), strict=True)):
                found = features(data[offsets[row]:offsets[row + 1]])
                counts[label, found] += 1
                texts[label] += 1
                if place <= cutoff:
                    out.append((label, place, found.astype("<u2").tobytes(), len(found)))
            yield _table(out)
    yield _table([(label + 2, None, _packed(counts[label]), texts[label]) for label in (0, 1) if texts[label]])


def _packed(counts: np.ndarray) -> bytes:
    """Features that occur, then how often."""
    found = np.flatnonzero(counts)
    return found.astype("<i8").tobytes() + counts[found].astype("<i8").tobytes()


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    texts: dict[int, int] = {}
    for batch in batches:
        for kind, found, n in zip(batch["kind"].to_pylist(), batch["found"].to_pylist(), batch["n"].to_pylist(), strict=True):
            place, more = np.frombuffer(found, "<i8").reshape(2, -1)
            sums.setdefault(kind, np.zeros(1 << BITS, np.int64))[place] += more
            texts[kind] = texts.get(kind, 0) + n
    yield _table([(kind, None, s.astype("<i8").tobytes(), texts[kind]) for kind, s in sums.items()])


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.int64()), strict=True)],
                           names=["kind", "place", "found", "n"])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id`` and ``score`` of each row (0 to 1, higher: quality 1 is likelier). Only the
    text is looked at, all of it; a null text scores as an empty one. Without a model every
    score is 0.5. Rows may repeat; an empty table gives no rows."""
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = told.value
        for batch in batches:
            for part in slices(batch):
                offsets, data = text_buffer(part["text"])
                scores = [0.5 if model is None else model.score(features(data[a:b]))
                          for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.record_batch([part["doc_id"], pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")

"""Nearest vectors by collision counting over sorted projections.

The largest inner product becomes the smallest distance on a sphere: every vector gets one
more component that fills it up to the largest norm, a query gets a zero there. Vectors are
projected on a few orthonormal directions, each kept as an array of its own, sorted.

A query opens a window around its own projection in each array. A vector that lies in enough
of the windows collides often enough to be verified by its exact inner product. Windows
belong to a radius and widen by doubling it (virtual rehashing: the arrays stay as they are)
until the k best verified vectors lie within the radius; a query that has k from earlier rows
starts at their radius. At the largest radius all rows are verified, so nothing is cut off.

Queries and rows are dealt out to (block of queries, part of the rows). A task streams its
rows in index blocks of bounded size and keeps k results per query; every query has a fixed
number of such lists, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bankrec.llm.shared import stored
from bankrec.session import task_count

PROJECTIONS = 64       # at most; never more than the vectors have directions
QUERIES = 2048         # of a block, about
PARTS = 16             # of the rows, for each block of queries
INDEX_ROWS = 4096      # of an index block
WIDTH = 1.5            # half a window, in standard deviations of a difference at the radius
CERTAINTY = 2.5        # standard deviations of the number of collisions that are allowed for
FIRST_RADIUS = 0.25    # on the unit sphere, where the farthest two points are 2 apart
_SEED = 7


def directions(size: int) -> np.ndarray:
    """Orthonormal directions (columns) for vectors of ``size`` components."""
    some = np.random.default_rng(_SEED).normal(size=(size, min(size, PROJECTIONS)))
    return np.linalg.qr(some)[0]


def enough(size: int) -> int:
    """Collisions that a vector within the radius has, nearly always.

    Differences in ``m`` of ``size`` orthonormal directions are nearly normal, and their
    squares have a fixed sum, which makes the count steadier than independent draws."""
    m = min(size, PROJECTIONS)
    certain = m - math.floor(size / WIDTH ** 2)        # more misses would exceed the radius
    if size < 16:
        return max(1, certain)
    inside = math.erf(WIDTH / math.sqrt(2))
    slope = 2 * WIDTH * math.exp(-WIDTH ** 2 / 2) / math.sqrt(2 * math.pi)
    spread = math.sqrt(m * (inside * (1 - inside) - m / size * slope ** 2 / 2))
    return max(1, certain, math.floor(m * inside - CERTAINTY * spread))


class Index:
    """A bounded number of vectors and their sorted projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float, axes: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        scaled = vectors / largest
        rest = np.sqrt(np.maximum(0.0, 1 - np.einsum("ij,ij->i", scaled, scaled)))
        places = scaled @ axes[:-1] + rest[:, None] * axes[-1]
        self.order = np.ascontiguousarray(places.argsort(axis=0).T)
        self.places = np.take_along_axis(places.T, self.order, axis=1)

    def colliding(self, centres: np.ndarray, radii: np.ndarray, least: int) -> Iterator[np.ndarray]:
        """For each query the rows that lie in at least ``least`` of its windows."""
        half = (WIDTH * radii / math.sqrt(self.size))[:, None]
        n, middle = len(self.ids), len(self.ids) // 2
        lows = np.stack([np.searchsorted(p, c, "left") for p, c in zip(self.places, (centres - half).T, strict=True)])
        highs = np.stack([np.searchsorted(p, c, "right") for p, c in zip(self.places, (centres + half).T, strict=True)])
        for low, high in zip(lows.T.tolist(), highs.T.tolist(), strict=True):
            counts = np.zeros(n, np.int64)
            inside, outside, wide = [], [], 0
            for order, a, b in zip(self.order, low, high, strict=True):
                if b - a <= middle:
                    inside.append(order[a:b])
                else:              # a window over most rows: count those it leaves out
                    outside += [order[:a], order[b:]]
                    wide += 1
            if inside:
                counts += np.bincount(np.concatenate(inside), minlength=n)
            if outside:
                counts -= np.bincount(np.concatenate(outside), minlength=n)
            yield np.flatnonzero(counts >= least - wide)

    @property
    def size(self) -> int:
        return self.vectors.shape[1] + 1


class Search:
    """The k best rows so far for each query of a block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float, k: int) -> None:
        self.ids, self.vectors, self.k, self.largest = ids, vectors, k, largest
        self.norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        self.axes = directions(vectors.shape[1] + 1)
        self.least = enough(vectors.shape[1] + 1)
        self.centres = (vectors / self.norms[:, None]) @ self.axes[:-1]
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0))] * len(ids)

    def _radius(self, q: int, scores: np.ndarray) -> float:
        """Distance of the k-th best on the unit sphere; beyond everything without k."""
        if len(scores) < self.k:
            return np.inf
        return math.sqrt(max(0.0, 2 - 2 * scores[-1] / (self.norms[q] * self.largest))) * (1 + 1e-9) + 1e-9

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        index = Index(ids, vectors, self.largest, self.axes)
        before = list(self.best)
        active = np.arange(len(self.ids))
        radii = np.array([min(r, FIRST_RADIUS) if math.isinf(r) else r
                          for r in (self._radius(q, s) for q, (_, s) in enumerate(before))])
        while len(active):
            left = []
            near = index.colliding(self.centres[active], radii[active], self.least)
            for q, rows in zip(active.tolist(), near, strict=True):
                if radii[q] >= 2:
                    rows = np.arange(len(ids))
                self.best[q] = self._merged(q, before[q], index, rows)
                reach = self._radius(q, self.best[q][1])
                if reach > radii[q] and radii[q] < 2:
                    radii[q] = min(2 * radii[q], max(reach, FIRST_RADIUS), 2.0)
                    left.append(q)
            active = np.array(left, np.int64)

    def _merged(self, q: int, before: tuple[np.ndarray, np.ndarray], index: Index, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = rows[index.ids[rows] != self.ids[q]]
        ids, scores = before
        rough = np.einsum("ij,j->i", index.vectors[rows], self.vectors[q])
        slack = 1e-9 * self.norms[q] * self.largest
        together = np.concatenate((scores, rough))
        if len(together) > self.k:
            rows = rows[rough >= np.partition(together, -self.k)[-self.k] - slack]
        if not len(rows):
            return before
        exact = np.zeros(len(rows))
        for ours, theirs in zip(self.vectors[q].tolist(), index.vectors[rows].T, strict=True):
            exact += ours * theirs        # in the order of the components, as SQL would
        ids, scores = np.concatenate((ids, index.ids[rows])), np.concatenate((scores, exact))
        order = np.lexsort((ids, -scores))[:self.k]
        return ids[order], scores[order]

    def found(self) -> pa.RecordBatch:
        counts = [len(i) for i, _ in self.best]
        return pa.record_batch([pa.array(np.repeat(self.ids, counts)),
                                pa.array(np.concatenate([i for i, _ in self.best])),
                                pa.array(np.concatenate([s for _, s in self.best]))],
                               names=["query_id", "vec_id", "score"])


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors as rows; a shorter one is filled up with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), size))
    out[np.arange(size) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def usable(vector: str = "embedding") -> Column:
    """Neither null, empty or zero, nor with a component that is null or not finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``vectors`` (``vec_id``, ``embedding``)
    that ``is_query`` (over ``vec_id``) holds for, the k rows with the largest inner products.

    Ranks start at 1, ties go to the smaller id; fewer than k other rows are all returned.
    Rows without id, and vectors that are not ``usable``, take no part. Of rows with one id
    the greatest vector counts. Shorter vectors are filled up with zeros. Other columns are
    ignored; an empty table, or one without queries, gives no rows. The search misses a
    neighbour now and then (see ``enough``); what it returns is exact.
    """
    spark = vectors.sparkSession
    rows = (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
            .where(F.col("vec_id").isNotNull() & usable()).groupBy("vec_id").agg(F.max("embedding").alias("embedding")))
    rows = stored(rows)
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    size, square, queries = rows.agg(F.max(F.size("embedding")), F.max(squares), F.count_if(is_query)).first()
    blocks = max(1, math.ceil((queries or 0) / QUERIES))
    # each part of the rows meets each block of queries
    data = rows.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
                       F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(PARTS)).cast("int").alias("part"),
                       F.lit(1).alias("kind"), "vec_id", "embedding")
    asked = rows.where(is_query).select(F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.lit(blocks)).cast("int").alias("block"),
                                        F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"),
                                        F.lit(0).alias("kind"), "vec_id", "embedding")
    tasks = max(task_count(spark), blocks * PARTS)
    dealt = (asked.union(data).repartition(tasks, "block", "part")
             .sortWithinPartitions("block", "part", "kind", "vec_id"))
    largest = math.sqrt(square or 1.0)
    found = dealt.mapInArrow(lambda batches: _search(batches, size or 1, largest, k), "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _search(batches: Iterator[pa.RecordBatch], size: int, largest: float, k: int) -> Iterator[pa.RecordBatch]:
    place, search = None, None
    asked: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        keys = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in ("block", "part", "kind")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            if hi == lo:
                continue
            if place != tuple(keys[:2, lo]):
                if search:
                    yield search.found()
                place, search, asked = tuple(keys[:2, lo]), None, []
            for at in range(lo, hi, INDEX_ROWS):
                part = batch.slice(at, min(INDEX_ROWS, hi - at))
                ids, rows = part["vec_id"].to_numpy(zero_copy_only=False), _matrix(part["embedding"], size)
                if keys[2, lo] == 0:
                    asked.append((ids, rows))
                elif asked or search:
                    search = search or Search(*map(np.concatenate, zip(*asked, strict=True)), largest, k)
                    search.add(ids, rows)
    if search:
        yield search.found()

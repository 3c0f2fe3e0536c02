"""Nearest resolved cases, by cosine similarity of their vectors.

The resolved vectors are grouped into cells around a fixed number of pivots. The
size and radius of the cells bound the similarity of a query to anything in a
cell, from below and above, so a query visits only the cells that can hold one of
its k best: the answer is exact. Neighbouring small cells are bundled, bundles are cut into blocks; a
task compares one block of queries with one block of vectors, cell by cell, and emits k rows per query
at most. A query is sent once to each block of a bundle, with the cells it visits there as bits, and
vectors are sent as bytes in the width they have; both are copied less the larger the blocks are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOP_K = 3
PIVOTS = 64
BLOCK = 4096                # rows of a block, at least
_WIDE = 1 << 17             # and at most, for short vectors: fewer copies of both sides
_VALUES = 1 << 23           # of a block, at most, beyond ``BLOCK`` rows
_COMPARED = 1 << 23         # similarities that a task holds at a time
_SLACK = 1e-9
_ROUNDED = 2e-12            # rounding to 12 digits never moves two values together from further apart
_CELL_SCHEMA = "id long, vetor binary, celula int, proximidade double"
_VISIT_SCHEMA = "id long, vetor binary, grupo int, celulas binary"
_PAIR_SCHEMA = "caso_id long, vizinho_id long, similaridade double"


def _unit(vectors) -> np.ndarray:
    return _scaled(np.stack([np.asarray(v, dtype=float) for v in vectors]))


def _scaled(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _packed(vectors, kind: str) -> list[bytes]:
    return [np.asarray(v, dtype=kind).tobytes() for v in vectors]


def _matrix(vectors, kind: str | None) -> np.ndarray:
    """Unit vectors, from themselves or from the bytes of what they were made of."""
    if kind is None:
        return np.stack(vectors.to_numpy())
    return _scaled(np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(float))


def _assign(pivots: np.ndarray, kind: str | None = None):
    """Nearest pivot of each vector; vectors without a direction get a cell of their own. Vectors
    are told as they come where ``kind`` names the type of their values."""
    def run(batches):
        for batch in batches:
            if len(batch) == 0:
                continue
            m = _unit(batch["embedding"])
            near = np.clip(m @ pivots.T, -1.0, 1.0)
            cell = near.argmax(axis=1)
            empty = ~m.any(axis=1)
            cell[empty] = len(pivots)
            best = np.where(empty, 0.0, near[np.arange(len(m)), near.argmax(axis=1)])
            yield pd.DataFrame({"id": batch["caso_id"], "vetor": list(m) if kind is None else _packed(batch["embedding"], kind),
                                "celula": cell.astype("int32"), "proximidade": best})
    return run


def _visits(pivots: np.ndarray, cells: list[tuple[int, int, float]], k: int,
            bundles: dict[int, list[int]] | None = None, kind: str | None = None):
    """The cells each query has to look into; with ``bundles``, a row for each bundle with such
    cells, and which they are as bits from its first cell on."""
    ids = np.array([c for c, _, _ in cells], dtype=int)
    sizes = np.array([n for _, n, _ in cells])
    no_direction = ids == len(pivots)
    radius = np.array([math.acos(min(1.0, max(-1.0, p))) for _, _, p in cells])

    def run(batches):
        for batch in batches:
            if len(batch) == 0:
                continue
            m = _unit(batch["embedding"])
            near = np.clip(m @ pivots.T, -1.0, 1.0)
            angle = np.arccos(near[:, np.minimum(ids, len(pivots) - 1)])
            high = np.cos(np.maximum(angle - radius, 0.0))
            low = np.cos(np.minimum(angle + radius, np.pi))
            flat = no_direction[None, :] | ~m.any(axis=1)[:, None]
            high, low = np.where(flat, 0.0, high), np.where(flat, 0.0, low)
            # k + 1 vectors are at least this similar; one of them may be the query itself
            order = np.argsort(-low, axis=1)
            reached = np.cumsum(sizes[order], axis=1) > k
            at = np.where(reached.any(axis=1), reached.argmax(axis=1), len(ids) - 1)
            sure = np.where(reached.any(axis=1),
                            np.take_along_axis(low, order, 1)[np.arange(len(m)), at], -2.0)
            visited = high >= sure[:, None] - _SLACK
            if bundles is not None:
                there, raw = batch["caso_id"].to_numpy(), np.array(_packed(batch["embedding"], kind), object)
                for first, own in bundles.items():
                    wanted = np.zeros((len(m), own[-1] - first + 1), bool)
                    wanted[:, np.array(own) - first] = visited[:, np.searchsorted(ids, own)]
                    query = np.flatnonzero(wanted.any(axis=1))
                    bits = np.packbits(wanted[query], axis=1)
                    yield pd.DataFrame({"id": there[query], "vetor": raw[query], "grupo": np.full(len(query), first, "int32"),
                                        "celulas": [b.tobytes() for b in bits]})
                continue
            query, cell = np.nonzero(visited)
            yield pd.DataFrame({"id": batch["caso_id"].to_numpy()[query],
                                "vetor": [m[i] for i in query],
                                "celula": ids[cell].astype("int32")})
    return run


def _bound(sims: np.ndarray, k: int) -> np.ndarray:
    """A value per row that at least ``k`` of its similarities reach: the k-th largest of the
    maxima of groups of columns, so that no row is sorted."""
    width = min(64, sims.shape[1] // (4 * k))
    if width < 2:
        return np.full(len(sims), -np.inf)
    groups = sims.shape[1] // width
    largest = np.fmax.reduce(sims[:, :width * groups].reshape(len(sims), width, groups), axis=1)
    largest[np.isnan(largest)] = -np.inf
    return np.partition(largest, groups - k, axis=1)[:, groups - k]


def _best(asked: np.ndarray, own: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Row, column and similarity of the k best of each row; ties by column. ``ids`` are ascending."""
    sims = asked @ vectors.T
    first, last = np.searchsorted(ids, own), np.searchsorted(ids, own, side="right")
    for i in np.nonzero(first < last)[0]:
        sims[i, first[i]:last[i]] = -np.inf
    row, column = np.nonzero(sims >= (_bound(sims, k) - _ROUNDED)[:, None])
    # equal vectors must tie, whatever the order of their sums
    value = np.round(sims[row, column], 12)
    order = np.lexsort((column, -value, row))
    row, column, value = row[order], column[order], value[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    keep = (rank < k) & np.isfinite(value)
    return row[keep], column[keep], value[keep]


def _met(key, queries: pd.DataFrame, vectors: pd.DataFrame) -> Iterator[tuple[np.ndarray, pd.DataFrame]]:
    """Places of queries, and the vectors they are compared with. Cells that the same queries
    visit are compared at once."""
    if "celulas" not in queries:
        yield np.arange(len(queries)), vectors
        return
    bits = np.frombuffer(b"".join(queries["celulas"]), np.uint8).reshape(len(queries), -1)
    wanted, cells = np.unpackbits(bits, axis=1).astype(bool), vectors["celula"].to_numpy()
    alike: dict[bytes, list[int]] = {}
    for cell in np.unique(cells):
        alike.setdefault(wanted[:, cell - int(key[0])].tobytes(), []).append(cell)
    for told, some in alike.items():
        yield np.flatnonzero(np.frombuffer(told, bool)), vectors[np.isin(cells, some)]


def _compare(k: int, kind: str | None = None):
    def run(key, queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(queries) and len(vectors):
            own, asked = queries["id"].to_numpy(), _matrix(queries["vetor"], kind)
            for places, some in _met(key, queries, vectors):
                some = some.sort_values("id")
                ids, there = some["id"].to_numpy(), _matrix(some["vetor"], kind)
                step = max(1, _COMPARED // len(ids))
                for i in range(0, len(places), step):
                    at = places[i:i + step]
                    row, column, value = _best(asked[at], own[at], ids, there, k)
                    found.append((at[row], ids[column], value))
        row, near, value = (np.concatenate(x) for x in zip(*found))
        # the best of a query's cells
        order = np.lexsort((near, -value, row))
        row, near, value = row[order], near[order], value[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        row = row[keep]
        return pd.DataFrame({"caso_id": queries["id"].to_numpy()[row], "vizinho_id": near[keep], "similaridade": value[keep]})
    return run


def _bundles(cells: list[tuple[int, int, float]], size: int) -> dict[int, list[int]]:
    """Cells side by side in bundles of ``size`` vectors, or of one cell that has more, by the
    first cell of each."""
    out: dict[int, list[int]] = {}
    first, held = None, 0
    for cell, n, _ in cells:
        if first is None or held + n > size:
            first, held = cell, 0
        out.setdefault(first, []).append(cell)
        held += n
    return out


def _lookup(values: dict[int, int], col: str) -> Column:
    """A value for each cell or bundle as a literal lookup."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col(col))


def _value_type(*frames: DataFrame) -> str:
    kinds = [df.schema["embedding"].dataType for df in frames]
    return "<f4" if all(isinstance(t, T.ArrayType) and isinstance(t.elementType, T.FloatType) for t in kinds) else "<f8"


def top_k(abertos: DataFrame, resolvidos: DataFrame, k: int = TOP_K, pivots: int = PIVOTS,
          block: int | None = None) -> DataFrame:
    """``(caso_id, rank, vizinho_id, similaridade)``: the k resolved cases most
    similar to each open one, other than itself; ties by id. Inputs are
    ``(caso_id, embedding)``. Only pivots and per-cell counts come to the driver."""
    chosen = (resolvidos.orderBy(F.xxhash64("caso_id"), "caso_id").limit(pivots)
              .select("embedding").collect())
    empty = abertos.sparkSession.createDataFrame(
        [], "caso_id long, rank int, vizinho_id long, similaridade double")
    if not chosen:
        return empty
    centres = _unit([row["embedding"] for row in chosen])
    kind = _value_type(abertos, resolvidos)
    tasks = abertos.sparkSession.sparkContext.defaultParallelism
    widest = max(BLOCK, min(_WIDE, _VALUES // max(1, centres.shape[1])))

    def size(rows: int) -> int:
        # two groups for each task at least, where blocks are not small anyway
        return block or min(widest, max(BLOCK, math.ceil(rows / math.sqrt(2 * tasks))))

    base = resolvidos.select("caso_id", "embedding").mapInPandas(_assign(centres, kind), _CELL_SCHEMA)
    cells = [tuple(r) for r in base.groupBy("celula")
             .agg(F.count("*"), F.min("proximidade")).orderBy("celula").collect()]
    counts = {c: n for c, n, _ in cells}
    vector_size = size(sum(counts.values()))
    bundles = _bundles(cells, vector_size)
    asked = (abertos.select("caso_id", "embedding")
             .mapInPandas(_visits(centres, cells, k, bundles, kind), _VISIT_SCHEMA))
    wanted = dict(tuple(r) for r in asked.groupBy("grupo").count().collect())
    if not wanted:
        return empty
    query_size = size(max(wanted.values()))
    vector_blocks = _lookup({g: -(-sum(counts[c] for c in own) // vector_size) for g, own in bundles.items()}, "grupo")
    query_blocks = _lookup({g: -(-n // query_size) for g, n in wanted.items()}, "grupo")

    def own(blocks: Column) -> Column:
        return F.pmod(F.xxhash64("id"), blocks).cast("int")

    def every(blocks: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), blocks - 1))

    keys = ["grupo", "_q", "_v"]
    queries = asked.withColumn("_q", own(query_blocks)).withColumn("_v", every(vector_blocks))
    vectors = (base.select("id", "vetor", "celula", _lookup({c: g for g, own in bundles.items() for c in own}, "celula").alias("grupo"))
               .where(query_blocks.isNotNull())
               .withColumn("_v", own(vector_blocks)).withColumn("_q", every(query_blocks)))
    pairs = (queries.groupBy(*keys).cogroup(vectors.groupBy(*keys))
             .applyInPandas(_compare(k, kind), _PAIR_SCHEMA))
    place = F.row_number().over(W.partitionBy("caso_id").orderBy(F.desc("similaridade"), "vizinho_id"))
    return pairs.withColumn("rank", place).where(F.col("rank") <= k).select(
        "caso_id", "rank", "vizinho_id", "similaridade")

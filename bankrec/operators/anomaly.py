"""Unusual amounts per company, by a one-dimensional isolation forest.

A tree cuts its amounts at a uniform place again and again. On a line that is the same as
giving each gap between neighbouring amounts an exponential waiting time, whose rate is the
gap's length, and cutting the gaps in the order of their times: the chance that a gap is the
first of its node is its share of the node's length. Samples, thresholds and scores are SQL; a
helper grows the trees of many companies at once and sums their heights at the amounts, so of a
forest only the sample and the heights travel.

With a single feature a forest is a step function of the amount. Cuts are whole cents and
heights whole multiples of 1 / ``ONE``, so sums of them are exact in any order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bankrec import skew
from bankrec.session import deal_out, stored

MIN_HISTORY = 10
TREES = 100
TREE_ROWS = 256
AMOUNTS_PER_PART = 100_000
SEED = 42
LEVELS = math.ceil(math.log2(TREE_ROWS))
ONE = 1 << 20
EULER = 0.5772156649015329
_POINTS = 1 << 18        # of all trees that grow side by side

# draws come from a multiplicative generator: a text's digest starts it, and each tree uses
# three of its steps (which rows it holds, the waiting times, the places of the cuts)
PRIME = (1 << 31) - 1
ROOT = 16807


def multipliers(kind: int) -> list[int]:
    """The generator's steps for all trees: 0 for rows, 1 for waiting times, 2 for places."""
    return [pow(ROOT, kind * TREES + t + 1, PRIME) for t in range(TREES)]


def _steps(kind: int) -> str:
    return "array(" + ", ".join(f"{m}L" for m in multipliers(kind)) + ")"


def _start(text: str) -> str:
    """1 to PRIME - 1 from the digest of a text."""
    return f"1L + cast(conv(substr(md5(concat_ws('/', '{SEED}', {text})), 1, 15), 16, 10) as bigint) % {PRIME - 1}L"


def path_length(m: int) -> float:
    """Mean depth of an unsuccessful search among m points."""
    return 2 * (math.log(m - 1) + EULER) - 2 * (m - 1) / m if m > 2 else float(m == 2)


def fixed_lengths() -> list[int]:
    """``path_length`` of 0 to ``TREE_ROWS`` points, times ``ONE``."""
    return [round(ONE * path_length(m)) for m in range(TREE_ROWS + 1)]


def eligible(movimentos: DataFrame) -> DataFrame:
    """Companies (raw names) with enough movements, any day."""
    return (movimentos.groupBy("empresa").agg(F.count("*").alias("n"))
            .where(F.col("n") >= MIN_HISTORY))


def samples(movimentos: DataFrame, min_rows: int = skew.MIN_ROWS) -> DataFrame:
    """``(empresa, arvores)`` of eligible companies: the sorted distinct amounts ``v`` in cents
    of each tree, the number of rows up to each ``ate``, and the start ``g`` of its draws. There is
    one entry, for all trees, where a tree can hold the whole history.

    A row has one digest, of its id; each tree takes the ``TREE_ROWS`` rows that come first in
    its own step of the generator. Rows far from the first ones are left out before the
    shuffle, so a company sends about as many as its trees need.
    """
    rows = movimentos.where("valor is not null").select("id", "empresa", _cents())
    counted = skew.join_lookup(rows, eligible(rows), ["empresa"], "inner", by="id", min_rows=min_rows)
    # ten standard deviations above the number wanted
    near = TREE_ROWS + 10 * TREE_ROWS ** 0.5
    trees = (f"if(n <= {TREE_ROWS}, array(struct(0 as arvore, h as lugar)), filter("
             f"transform({_steps(0)}, (m, t) -> struct(t as arvore, (h * m) % {PRIME}L as lugar)), "
             f"x -> x.lugar < {near}D / n * {PRIME}D))")
    first = F.row_number().over(W.partitionBy("empresa", "arvore").orderBy("lugar", "id"))
    upto = F.sum("c").over(W.partitionBy("empresa", "arvore").orderBy("centimos"))
    drawn = (counted.withColumn("h", F.expr(_start("id")))
             .select("id", "empresa", "centimos", F.inline(F.expr(trees)))
             .withColumn("_r", first).where(F.col("_r") <= TREE_ROWS)
             .groupBy("empresa", "arvore", "centimos").agg(F.count("*").alias("c"))
             .withColumns({"g": F.expr(_start("empresa, centimos")), "ate": upto})
             .groupBy("empresa", "arvore")
             .agg(F.array_sort(F.collect_list(F.struct(F.col("centimos").alias("v"), "ate", "g"))).alias("amostra")))
    return drawn.groupBy("empresa").agg(F.array_sort(F.collect_list(F.struct("arvore", "amostra"))).alias("arvores"))


def depths(times: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The depth of each gap in its tree, all trees level by level: the first gap of a run is
    its cut, and what lies before and after it are the runs of the next level. ``times`` holds the
    trees one after another. Gaps below ``LEVELS`` levels have that depth."""
    depth = np.full(len(times), LEVELS, dtype=np.int32)
    padded = np.append(times, np.inf)
    end = np.cumsum(sizes)
    start = end - sizes
    for level in range(LEVELS):
        some = start < end
        start, end = start[some], end[some]
        if len(start) == 0:
            break
        size = end - start
        run = np.repeat(np.arange(len(start)), size)
        at = np.arange(len(run)) + np.repeat(start - (np.cumsum(size) - size), size)
        least = np.minimum.reduceat(padded, np.column_stack([start, end]).ravel())[::2]
        hit = padded[at] == least[run]
        _, first = np.unique(run[hit], return_index=True)
        cut = at[hit][first]
        depth[cut] = level
        start, end = np.column_stack([start, cut + 1]).ravel(), np.column_stack([cut, end]).ravel()
    return depth


def _rises(size: np.ndarray, v: np.ndarray, upto: np.ndarray, g: np.ndarray, own: np.ndarray, tree: np.ndarray) -> tuple[np.ndarray, ...]:
    """What the height rises by above each cut of many trees: ``(tree, cut, rise, first)``. ``first``
    marks the height of a tree below all of its cuts. Samples of ``size`` points follow each other
    in ``v``, ``upto`` and ``g``; the trees have the samples ``own`` and the numbers ``tree``."""
    gaps, begin = size[own] - 1, (np.cumsum(size) - size)[own]
    rows = upto[begin + gaps]
    of = np.repeat(np.arange(len(own)), gaps)
    at = np.arange(len(of)) + np.repeat(begin - (np.cumsum(gaps) - gaps), gaps)
    length = v[at + 1] - v[at]
    draw = lambda kind: (g[at] * np.array(multipliers(kind))[tree][of] % PRIME) / PRIME
    depth = depths(-np.log(draw(1)) / length, gaps)
    cut = v[at] + np.floor(length * draw(2)).astype(np.int64)
    kept = depth < np.ceil(np.log2(np.maximum(rows, 2)))[of]
    # the cuts of a tree with its end behind them; each closes an interval
    closed = np.bincount(of[kept], minlength=len(own)) + 1
    last = np.cumsum(closed) - 1
    first = last - closed + 1
    inner = np.ones(int(closed.sum()), dtype=bool)
    inner[last] = False

    def placed(values: np.ndarray, end, before) -> tuple[np.ndarray, np.ndarray]:
        whole = np.empty(len(inner), dtype=np.int64)
        whole[inner], whole[last] = values[kept], end
        previous = np.roll(whole, 1)
        previous[first] = before
        return whole, previous

    deep, deep_before = placed(depth, -1, -1)
    up, up_before = placed(upto[at], rows, 0)
    height = ONE * (1 + np.maximum(deep, deep_before)) + np.array(fixed_lengths())[up - up_before]
    lower = np.roll(height, 1)
    lower[first] = 0
    begins = np.zeros(len(inner), dtype=bool)
    begins[first] = True
    return np.repeat(np.arange(len(own)), closed), placed(cut, 0, 0)[1], height - lower, begins


def _forests(samples: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of each company's samples ``(rows of a tree, height below all cuts, cuts, rises)``, a bounded
    number of points at a time. One sample serves all trees where there is only one."""
    count = samples.value_lengths().to_numpy()
    trees = samples.flatten()
    points = trees.field("amostra")
    size, number, held = points.value_lengths().to_numpy(), trees.field("arvore").to_numpy(), points.flatten()
    v, upto, g = (held.field(name).to_numpy() for name in ("v", "ate", "g"))
    first, end = np.cumsum(count) - count, np.cumsum(size)
    grown = np.where(count == 1, TREES, count)
    weight = np.add.reduceat(size, first) * np.where(count == 1, TREES, 1) if len(count) else count
    block = np.cumsum(weight) // _POINTS
    for start, stop in zip(np.flatnonzero(np.diff(block, prepend=-1)), [*np.flatnonzero(np.diff(block)) + 1, len(block)]):
        companies = np.repeat(np.arange(start, stop), grown[start:stop])
        nth = np.arange(len(companies)) - np.repeat(np.cumsum(grown[start:stop]) - grown[start:stop], grown[start:stop])
        single = count[companies] == 1
        own = first[companies] + np.where(single, 0, nth)
        low, high = first[start], first[stop - 1] + count[stop - 1]
        held_by = slice(end[low] - size[low], end[high - 1])
        of, cut, rise, begins = _rises(size[low:high], v[held_by], upto[held_by], g[held_by], own - low, np.where(single, nth, number[own]))
        bounds = np.searchsorted(companies[of], np.arange(start, stop + 1))
        for company, (lo, hi) in enumerate(zip(bounds, bounds[1:]), start):
            above = ~begins[lo:hi]
            yield (int(upto[end[first[company]] - 1]), int(rise[lo:hi][~above].sum()), cut[lo:hi][above], rise[lo:hi][above])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, (n, base, cut, rise) in zip(batch.column("empresa"), _forests(batch.column("arvores"))):
            order = np.argsort(cut)
            cut, height = cut[order], base + np.cumsum(rise[order])
            # equal cuts are one step
            alone = np.append(cut[1:] > cut[:-1], True)[:len(cut)]
            columns = [[name.as_py()], [n], [cut[alone]], [np.append(base, height[alone])]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (
                pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())))], ["empresa", "n", "cortes", "alturas"])


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The amounts of each row with the summed height of their company's trees."""
    for batch in batches:
        amounts = batch.column("a")
        held, size = amounts.flatten(), amounts.value_lengths().to_numpy()
        cents, bounds = held.field("centimos").to_numpy(), np.append(0, np.cumsum(size))
        heights, rows = np.empty(len(cents), dtype=np.int64), np.empty(len(size), dtype=np.int32)
        for at, (n, base, cut, rise) in enumerate(_forests(batch.column("arvores"))):
            own = cents[bounds[at]:bounds[at + 1]]
            order = np.argsort(own)
            # a cut raises the amounts above it; sums of whole numbers are exact
            raised = np.bincount(np.searchsorted(own[order], cut, side="right"), rise, len(own) + 1)[:-1]
            heights[bounds[at] + order] = base + np.cumsum(raised).astype(np.int64)
            rows[at] = n
        yield pa.RecordBatch.from_arrays([
            batch.column("empresa").take(pa.array(np.repeat(np.arange(len(size)), size))), pa.array(cents), held.field("n"),
            pa.array(heights), pa.array(np.repeat(rows, size))], ["empresa", "centimos", "n", "altura", "linhas"])


def _score(height: str, rows: str) -> str:
    """The score of a summed height in a forest whose trees hold so many rows."""
    scale = "array(" + ", ".join(f"{max(path_length(m), 1e-9)!r}D" for m in range(TREE_ROWS + 1)) + f")[{rows}]"
    return f"-power(2D, -({height} / ({scale} * {ONE * TREES}D)))"


def fit(movimentos: DataFrame) -> DataFrame:
    """One row per eligible company: its forest as ``cortes`` (cents), ``alturas`` (summed heights
    of the intervals between them, times ``ONE``) and ``notas`` (their scores). A company
    has ``TREES * TREE_ROWS`` cuts at most."""
    # heavy work for its few bytes
    grown = deal_out(samples(movimentos), "empresa").select("empresa", "arvores").mapInArrow(
        _fitted, "empresa string, n int, cortes array<bigint>, alturas array<bigint>")
    return grown.selectExpr("empresa", "cortes", "alturas", f"transform(alturas, a -> {_score('a', 'n')}) as notas")


def _cents():
    return F.expr("cast(valor * 100 as bigint) as centimos")


def score_amounts(movimentos: DataFrame, rows_per_part: int = AMOUNTS_PER_PART) -> DataFrame:
    """Distinct amounts of each eligible company with their count, their summed height and
    their score. Lower is more unusual. A forest is grown where its amounts are, so its cuts
    never leave the task; a company with many distinct amounts is scored in parts, and its
    sample, which is bounded, goes to each."""
    amounts = (movimentos.where("valor is not null").select("empresa", _cents()).groupBy("empresa", "centimos")
               .agg(F.count("*").alias("n")))
    heavy = skew.parts_of_heavy_keys(amounts.groupBy("empresa").agg(F.count("*").alias("_n")),
                                     "_n", rows_per_part)
    parts = (amounts.join(heavy, "empresa", "left")
             .groupBy("empresa", F.expr("pmod(xxhash64(centimos), coalesce(_partes, 1)) as _parte"))
             .agg(F.collect_list(F.struct("centimos", "n")).alias("a")))
    copies = (samples(movimentos).join(heavy, "empresa", "left").selectExpr(
        "empresa", "arvores", "explode(sequence(0L, coalesce(_partes, 1) - 1L)) as _parte"))
    rows = parts.join(copies, ["empresa", "_parte"]).withColumn("_onde", F.concat_ws("/", "empresa", "_parte"))
    scored = deal_out(rows, "_onde").select("empresa", "a", "arvores").mapInArrow(
        _scored, "empresa string, centimos bigint, n bigint, altura bigint, linhas int")
    return scored.selectExpr("empresa", "centimos", "n", "altura", f"{_score('altura', 'linhas')} as nota")


def flag(movimentos: DataFrame, contaminacao: float = 0.1, dia=None,
         min_rows: int = skew.MIN_ROWS, rows_per_part: int = AMOUNTS_PER_PART) -> DataFrame:
    """Movements whose score is strictly below the contamination quantile of their
    company's whole history. ``dia`` limits the answer, not the history."""
    # read three times below, and dear to make
    scored = stored(score_amounts(movimentos, rows_per_part))
    # scores rise with heights, and heights are exact
    threshold = scored.groupBy("empresa").agg(
        F.percentile("altura", F.lit(contaminacao), F.col("n")).alias("limite"))
    unusual = (skew.join_lookup(scored, threshold, ["empresa"], "inner", by="centimos",
                                min_rows=min_rows)
               .where("altura < limite").select("empresa", "centimos", F.col("nota").alias("score")))
    rows = movimentos if dia is None else movimentos.where(F.col("dia") == F.lit(dia))
    return (skew.join_lookup(rows.select("id", "dia", "empresa", "descricao", "valor", _cents()),
                             unusual, ["empresa", "centimos"], "inner", by="id", min_rows=min_rows)
            .drop("centimos"))

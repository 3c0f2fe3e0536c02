"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Each shard stands at ``virtual`` places of a ring of hashes. A document goes to the next
place clockwise; a shard that is full passes the rest on clockwise. Capacities are equal to
within one row, so counts are at most one apart.

The ring is dealt with by counts: rows are counted in a fixed number of ring segments, the
counts (a bounded table) decide which run of each segment goes where, and rows take the
shard of their run by their rank in the segment.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass
from hashlib import md5

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VIRTUAL = 64
_BITS = 60            # of a place on the ring
_SLICE_BITS = 12      # the ring is cut into 4096 slices besides the places of shards
_MAX_PLACES = 1 << 13


@dataclass
class _Run:
    """Rows ``start`` to ``start + n`` of the stretch before place ``origin``, waiting at ``place``."""
    origin: int
    start: int
    n: int
    place: int


def place_of(text: str) -> int:
    return int(md5(text.encode()).hexdigest()[:_BITS // 4], 16)


def ring(shards: int, virtual: int) -> list[tuple[int, int]]:
    """``(place, shard)`` in ring order."""
    return sorted((place_of(f"shard {s} place {v}"), s) for s in range(shards) for v in range(virtual))


def fill(counts: list[int], owners: list[int], shards: int) -> list[tuple[int, int, int, int]]:
    """``(origin, start, n, shard)``: where each run of each stretch goes. Rounds: every
    waiting run asks the shard at its place, which takes runs in ring order until it is
    full; what is left moves on to the next place whose shard has room."""
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    waiting = [_Run(k, 0, n, k) for k, n in enumerate(counts) if n]
    placed = []
    while waiting:
        left = []
        for run in sorted(waiting, key=lambda r: (r.place, r.origin, r.start)):
            shard = owners[run.place]
            taken = min(run.n, room[shard])
            if taken:
                placed.append((run.origin, run.start, taken, shard))
                room[shard] -= taken
            if taken < run.n:
                left.append(_Run(run.origin, run.start + taken, run.n - taken, run.place))
        for run in left:
            while not room[owners[run.place]]:
                run.place = (run.place + 1) % len(owners)
        waiting = left
    return sorted(placed)


def assign(docs: DataFrame, shards: int = 16, virtual: int = VIRTUAL) -> DataFrame:
    """All rows with their shard: ``doc_id``, ``size`` (UTF-8 bytes plus one), ``text_crc32``,
    ``law`` (``rows``), ``shard``, ``slot`` (gapless from 0 in each shard) and
    ``grown_shard`` (null: this law promises nothing for another number of shards).

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. A null text has no
    bytes. The place of a row follows from its ``doc_id``; without one, from its text. Rows
    of one ``doc_id`` stand together, ordered by text. An empty table gives no rows.
    """
    places = ring(shards, virtual)
    if len(places) > _MAX_PLACES:
        raise ValueError(f"{_MAX_PLACES} places on the ring at most")
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("hash"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("hash").cast("string")))
    rows = rows.withColumn("place", F.conv(F.substring(F.md5(name), 1, _BITS // 4), 16, 10).cast("long"))
    shift = _BITS - _SLICE_BITS
    cuts = spark.createDataFrame(_slices([p for p, _ in places], shift), "slice long, stretch int, inner array<long>")
    rows = (rows.withColumn("slice", F.shiftright("place", shift)).join(F.broadcast(cuts), "slice")
            .withColumn("stretch", F.expr(f"(stretch + size(filter(inner, c -> c < place))) % {len(places)}")).drop("inner"))

    counts = {(r["slice"], r["stretch"]): r["n"] for r in
              rows.groupBy("slice", "stretch").agg(F.count("*").alias("n")).collect()}   # slices + places at most
    sums, offsets = [0] * len(places), []
    for (piece, stretch), n in sorted(counts.items()):
        offsets.append((piece, stretch, sums[stretch]))
        sums[stretch] += n
    runs, used = [], [0] * shards
    for origin, start, n, shard in fill(sums, [s for _, s in places], shards):
        runs.append((origin, start, start + n, shard, used[shard] - start))
        used[shard] += n
    by_stretch: dict[int, list] = {}
    for origin, *run in runs:
        by_stretch.setdefault(origin, []).append(run)
    known = spark.createDataFrame(
        [(piece, stretch, offset, by_stretch[stretch]) for piece, stretch, offset in offsets],
        "slice long, stretch int, offset long, runs array<struct<start:long,stop:long,shard:int,base:long>>")
    order = "row_number() over (partition by slice, stretch order by place, doc_id, text_crc32, size, hash) - 1"
    ranked = (rows.withColumn("rank", F.expr(order)).join(F.broadcast(known), ["slice", "stretch"])
              .withColumn("rank", F.expr("rank + offset"))
              .withColumn("run", F.expr("filter(runs, r -> r.start <= rank and rank < r.stop)[0]")))
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("run.shard").alias("shard"),
                         (F.col("run.base") + F.col("rank")).cast("long").alias("slot"),
                         F.lit(None).cast(T.IntegerType()).alias("grown_shard"))


def _slices(places: list[int], shift: int) -> list[tuple[int, int, list[int]]]:
    """For each slice of the ring the stretch at its beginning and the places inside it."""
    out = []
    for piece in range(1 << _SLICE_BITS):
        lo, hi = bisect_left(places, piece << shift), bisect_left(places, (piece + 1) << shift)
        out.append((piece, lo, places[lo:hi]))
    return out

"""The trie of conversation prefixes, from sorted conversations and their common prefixes.

Conversations are sorted by their turns (each a 128-bit digest, so equal beginnings lie next
to each other) and cut into blocks of neighbours. Each knows how many turns it shares with
the one before. A prefix of ``d`` turns is a candidate where it first occurs, and its members
are the neighbours on both sides as long as the minimum of the shared lengths is ``d`` or
more: a sparse table answers minima of ranges, and each candidate searches its left and its
right end by halving steps, alone, without a stack. What nodes report are differences of
running sums over the interval, and range minima of ids.

An interval may leave its block. Blocks exchange summaries: their minimum, their sums, and
the few places where the running minimum from either border drops. A sparse table over the
minima of blocks takes the search to the block where the interval ends.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankrec.llm.shared import stored
from bankrec.session import task_count

BLOCK = 50_000     # conversations of a block, about; there are as many blocks as tasks at least
_DIGEST = 16       # bytes of a turn's digest
_EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
         "saved_tokens long, ends_sha256 string, ends_block int, ends string, owner int")


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns``, an array of ``(key, n_words)`` in order, of ``turns``
    (``conv_id``, ``turn``, ``role``, ``text``). A null turn comes first; equal turns go by
    digest; null roles and texts are empty; rows without ``conv_id`` are left out. Only
    digests are shuffled. One conversation is held by one task, 20 bytes a turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct("turn", F.substring(F.unhex(F.sha2(whole, 256)), 1, _DIGEST).alias("key"),
                 F.regexp_count(text, F.lit(r"[^ \t-\r]+")).alias("n_words")).alias("told"))
    order = F.array_sort(F.collect_list("told"), lambda a, b: (
        F.when(a["turn"].isNull() & b["turn"].isNotNull(), -1).when(a["turn"].isNotNull() & b["turn"].isNull(), 1)
        .when(a["turn"] < b["turn"], -1).when(a["turn"] > b["turn"], 1)
        .when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
    return rows.groupBy("conv_id").agg(F.transform(order, lambda t: F.struct(t["key"], t["n_words"])).alias("turns"))


def nodes(convs: DataFrame) -> DataFrame:
    """The nodes of the trie over ``convs`` (``conv_id``, unique; ``turns`` as of ``sequences``).

    One row per distinct prefix of ``depth`` turns, the root (0) included: ``conv_id``, its
    smallest member; ``parent_conv_id``; ``n_convs``, members; ``n_children``; ``n_leaves``
    of its subtree; ``saved_tokens``, what its subtree's last turns would repeat; and
    ``ends_sha256`` of the ids that end here. Conversations without turns are members of the
    root alone; no conversations give no rows. Other columns are ignored.
    """
    blocks, borders = _sorted(convs)
    summaries = blocks.groupBy("block").applyInArrow(
        lambda table: _summary(table, borders), "block int, told binary").collect() if borders else []
    layout = Layout.of([(r["block"], Summary.unpack(r["told"])) for r in summaries])
    told = convs.sparkSession.sparkContext.broadcast((borders, layout))
    rows = stored(blocks.groupBy("block").applyInArrow(lambda table: _nodes(table, *told.value), _NODE))
    digest = (rows.where("ends is not null").select("owner", "ends_block", "ends")
              .repartition("owner").sortWithinPartitions("owner", "ends_block")
              .mapInArrow(_digests, "owner int, digest string"))
    found = rows.where("depth is not null").join(digest, "owner", "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("digest", "ends_sha256").alias("ends_sha256"))


# ---- sorting

@dataclass
class Border:
    shared: int        # turns the block's first conversation shares with the one before
    after: int         # turns the next block's first conversation shares with the block's last
    opens_copy: bool   # whether the first one equals the one before


def _sorted(convs: DataFrame) -> tuple[DataFrame, dict[int, Border]]:
    """Conversations in blocks of neighbours, ``shared`` null for the first of a block, and
    what the blocks' borders share."""
    rows = stored(convs.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), "")).alias("keys"),
                               F.transform("turns", lambda t: t["n_words"].cast("int")).alias("n_words")))
    count = max(task_count(convs.sparkSession), -(-rows.count() // BLOCK))
    ordered = (rows.repartitionByRange(count, "keys", "conv_id").sortWithinPartitions("keys", "conv_id")
               .withColumn("block", F.spark_partition_id()))
    # only the first and the last of a block keep their keys
    blocks = stored(ordered.mapInArrow(_neighbours, "block int, place int, conv_id long, shared int, n_words array<int>, edge binary"))
    edges: dict[int, list[bytes]] = {}
    for r in blocks.where("edge is not null").select("block", "place", "edge").orderBy("block", "place").collect():
        edges.setdefault(r["block"], []).append(bytes(r["edge"]))
    order = sorted(edges)
    shared = [-1] + [_common(edges[a][-1], edges[b][0]) for a, b in zip(order, order[1:])] + [-1]
    copies = [False] + [edges[a][-1] == edges[b][0] for a, b in zip(order, order[1:])]
    return blocks.drop("edge"), {b: Border(shared[k], shared[k + 1], copies[k]) for k, b in enumerate(order)}


def _common(a: bytes, b: bytes) -> int:
    """Turns that two conversations share from the beginning."""
    n = min(len(a), len(b)) // _DIGEST
    if a[:n * _DIGEST] == b[:n * _DIGEST]:
        return n
    x, y = (np.frombuffer(k, "<u8", 2 * n).reshape(n, 2) for k in (a, b))
    return int((x != y).any(axis=1).argmax())


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before, place = None, 0
    held = None       # the last row, told only when it is known whether it ends the block
    for batch in batches:
        keys = batch["keys"].to_pylist()
        if not keys:
            continue
        shared, edge = [], []
        for k in keys:
            shared.append(None if before is None else _common(before, k))
            edge.append(k if before is None else None)
            before = k
        told = pa.record_batch([batch["block"], pa.array(range(place, place + len(keys)), pa.int32()), batch["conv_id"],
                                pa.array(shared, pa.int32()), batch["n_words"], pa.array(edge, pa.binary())],
                               names=["block", "place", "conv_id", "shared", "n_words", "edge"])
        place += len(keys)
        if held is not None:
            yield held
        yield told.slice(0, len(keys) - 1)
        held = told.slice(len(keys) - 1)
    if held is not None:
        yield held.set_column(5, "edge", pa.array([before], pa.binary()))


# ---- one block

class RangeMin:
    """Minima of ranges: row ``j`` of the table has the minima of ``2**j`` neighbours."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= len(values):
            half = 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(self.rows[-1][:-half], self.rows[-1][half:]))

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Of places ``lo`` to ``hi``, both included."""
        j = np.frexp((hi - lo + 1).astype(float))[1] - 1
        out = np.empty(len(lo), self.rows[0].dtype)
        for k in np.unique(j).tolist():
            at = j == k
            out[at] = np.minimum(self.rows[k][lo[at]], self.rows[k][hi[at] - (1 << k) + 1])
        return out

    def reach_right(self, place: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The last place up to which all values behind ``place`` are ``bound`` or more."""
        place, n = place.copy(), len(self.rows[0])
        for j in range(len(self.rows) - 1, -1, -1):
            can = place + (1 << j) < n
            can[can] = self.rows[j][place[can] + 1] >= bound[can]
            place[can] += 1 << j
        return place

    def reach_left(self, place: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The first place from which on all values behind it, up to ``place``, are ``bound`` or more."""
        place = place.copy()
        for j in range(len(self.rows) - 1, -1, -1):
            can = place - (1 << j) + 1 >= 0
            can[can] = self.rows[j][place[can] - (1 << j) + 1] >= bound[can]
            place[can] -= 1 << j
        return place


class Block:
    """Conversations of a block in order, with the first one's shared turns filled in."""

    def __init__(self, table: pa.Table, border: Border) -> None:
        table = table.sort_by("place").combine_chunks()
        self.ids = table["conv_id"].to_numpy().astype(np.int64)
        self.shared = table["shared"].fill_null(border.shared).to_numpy().astype(np.int64)
        words = table["n_words"].combine_chunks()
        if isinstance(words, pa.ChunkedArray):
            words = pa.concat_arrays(words.chunks)
        self.length = words.value_lengths().to_numpy().astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.length)))
        self.total = np.concatenate(([0], np.cumsum(words.flatten().to_numpy().astype(np.int64))))
        n = len(self.ids)
        self.n = n
        every = np.arange(n)
        # words of the turns shared with the one before: what it saves there
        self.saved = np.concatenate(([0], np.cumsum(self.words_to(every, np.maximum(self.shared, 0)))))
        after = np.concatenate((self.shared[1:], [border.after]))
        self.leaves = np.concatenate(([0], np.cumsum(after < self.length)))
        self.longer = self.length > self.shared
        self.copy = np.concatenate(([border.opens_copy], (self.shared[1:] == self.length[1:]) & (self.length[1:] == self.length[:-1])))
        self.least = RangeMin(self.shared)
        self.least_id = RangeMin(self.ids)
        key = self.shared[self.longer] * n + every[self.longer]
        self.branches = np.sort(key)

    def words_to(self, row: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Words of the first ``depth`` turns."""
        return self.total[self.first[row] + depth] - self.total[self.first[row]]

    def branching(self, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """How many of the rows behind ``lo``, up to ``hi``, go on after ``depth`` shared turns."""
        return (np.searchsorted(self.branches, depth * self.n + hi, "right")
                - np.searchsorted(self.branches, depth * self.n + lo, "right"))


@dataclass
class Summary:
    """What other blocks need to know. ``left`` lists the places where the minimum from the
    left border drops: per step its value, and rows, saved words, leaves, smallest id and
    branches at that value of all rows before the step ends; ``right`` the value and the smallest
    id from the right border."""

    rows: int
    saved: int
    leaves: int
    least_id: int
    least: int
    copies: int        # rows at the left border that equal the last one before it
    left: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    right: list[tuple[int, int]] = field(default_factory=list)

    @staticmethod
    def of(b: Block) -> Summary:
        lead = int(np.append(b.copy, False).argmin())
        out = Summary(b.n, int(b.saved[-1]), int(b.leaves[-1]), int(b.ids.min()), int(b.shared.min()), lead)
        floor = np.minimum.accumulate(b.shared)
        ends = np.flatnonzero(np.concatenate((floor[1:] < floor[:-1], [True])))
        ids = np.minimum.accumulate(b.ids)
        for e in ends.tolist():
            v = int(floor[e])
            branches = int((b.longer[:e + 1] & (b.shared[:e + 1] == v)).sum())
            out.left.append((v, e + 1, int(b.saved[e + 1]), int(b.leaves[e + 1]), int(ids[e]), branches))
        # a row is reached from the right border if all rows behind it share enough
        floor = np.minimum.accumulate(np.concatenate(([np.iinfo(np.int64).max], b.shared[:0:-1])))
        ids = np.minimum.accumulate(b.ids[::-1])
        ends = np.flatnonzero(np.concatenate((floor[1:] < floor[:-1], [True])))
        out.right = [(int(floor[e]), int(ids[e])) for e in ends.tolist()]
        return out

    def pack(self) -> bytes:
        head = [self.rows, self.saved, self.leaves, self.least_id, self.least, self.copies, len(self.left), len(self.right)]
        flat = head + [x for step in self.left for x in step] + [x for step in self.right for x in step]
        return np.array(flat, "<i8").tobytes()

    @staticmethod
    def unpack(told: bytes) -> Summary:
        flat = np.frombuffer(told, "<i8").tolist()
        *head, n, m = flat[:8]
        left, right = flat[8:8 + 6 * n], flat[8 + 6 * n:8 + 6 * n + 2 * m]
        return Summary(*head, [tuple(left[k:k + 6]) for k in range(0, 6 * n, 6)],
                       [tuple(right[k:k + 2]) for k in range(0, 2 * m, 2)])


def _summary(table: pa.Table, borders: dict[int, Border]) -> pa.Table:
    number = table["block"][0].as_py()
    told = Summary.of(Block(table, borders[number])).pack()
    return pa.table({"block": pa.array([number], pa.int32()), "told": pa.array([told], pa.binary())})


# ---- across blocks

@dataclass
class Layout:
    """All blocks in order; as many rows as there are blocks."""

    blocks: list[int]
    summaries: list[Summary]
    least: RangeMin | None
    least_id: RangeMin | None
    rows: np.ndarray
    saved: np.ndarray
    leaves: np.ndarray

    @staticmethod
    def of(told: list[tuple[int, Summary]]) -> Layout:
        told = sorted(told, key=lambda t: t[0])
        all_of = [s for _, s in told]
        sums = [np.concatenate(([0], np.cumsum([getattr(s, c) for s in all_of], dtype=np.int64))) for c in ("rows", "saved", "leaves")]
        return Layout([b for b, _ in told], all_of, RangeMin(np.array([s.least for s in all_of], np.int64)) if all_of else None,
                      RangeMin(np.array([s.least_id for s in all_of], np.int64)) if all_of else None, *sums)

    def beyond_right(self, at: int, depth: int) -> tuple[int, int, int, int | None, int]:
        """Rows, saved words, leaves, smallest id and branches of the members after block ``at``."""
        last = int(self.least.reach_right(np.array([at]), np.array([depth]))[0])
        rows, saved, leaves = (int(c[last + 1] - c[at + 1]) for c in (self.rows, self.saved, self.leaves))
        ids, branches = [], 0
        if last > at:
            ids.append(int(self.least_id.least(np.array([at + 1]), np.array([last]))[0]))
            branches = sum(self.summaries[b].left[-1][5] for b in range(at + 1, last + 1) if self.summaries[b].least == depth)
        if last + 1 < len(self.blocks):
            steps = self.summaries[last + 1].left
            k = bisect_right([-s[0] for s in steps], -depth) - 1     # the last step of ``depth`` or more
            if k >= 0:
                value, n, words, ends, least, of_value = steps[k]
                rows, saved, leaves = rows + n, saved + words, leaves + ends
                ids.append(least)
                branches += of_value if value == depth else 0
        return rows, saved, leaves, min(ids, default=None), branches

    def beyond_left(self, at: int, depth: int) -> int:
        """The smallest id of the members before block ``at``, whose first row is one of them."""
        first = int(self.least.reach_left(np.array([at - 1]), np.array([depth]))[0])    # blocks behind it are members
        ids = [least for value, least in self.summaries[first].right if value >= depth][-1:]
        if first + 1 < at:
            ids.append(int(self.least_id.least(np.array([first + 1]), np.array([at - 1]))[0]))
        return min(ids)

    def origin(self, at: int) -> int:
        """Number of the block in which the copies that open block ``at`` begin."""
        at -= 1
        while self.summaries[at].copies == self.summaries[at].rows:
            at -= 1
        return self.blocks[at]


def _nodes(table: pa.Table, borders: dict[int, Border], layout: Layout) -> pa.Table:
    number = table["block"][0].as_py()
    b = Block(table, borders[number])
    at = layout.blocks.index(number)
    # candidates: every prefix where it first occurs, and before these the parent of a row's first one
    top = np.maximum(b.shared, 0)
    count = b.length - top + 1
    row = np.repeat(np.arange(b.n), count)
    depth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + top[row]
    left, right = b.least.reach_left(row, depth), b.least.reach_right(row, depth)
    over_left, over_right = np.flatnonzero(left < 0), np.flatnonzero(right == b.n - 1)
    left = np.maximum(left, 0)
    conv = b.least_id.least(left, right)
    n_convs = right - left + 1
    saved = b.saved[right + 1] - b.saved[left + 1]
    leaves = b.leaves[right + 1] - b.leaves[left]
    children = b.branching(left, right, depth) + (b.length[left] > depth)
    before = {d: layout.beyond_left(at, d) for d in np.unique(depth[over_left]).tolist()}
    for k in over_left.tolist():
        conv[k] = min(conv[k], before[int(depth[k])])
    behind = {d: layout.beyond_right(at, d) for d in np.unique(depth[over_right]).tolist()}
    for k in over_right.tolist():
        more, words, ends, least, branches = behind[int(depth[k])]
        n_convs[k] += more
        saved[k] += words
        leaves[k] += ends
        children[k] += branches
        conv[k] = conv[k] if least is None else min(conv[k], least)
    # words above the node are no savings of its subtree
    saved -= (n_convs - 1) * b.words_to(row, np.maximum(depth - 1, 0))
    parent = np.concatenate(([0], conv[:-1]))       # candidates of a row follow each other
    keep = np.flatnonzero(depth > b.shared[row])
    ends, owners, pieces = _ends(b, layout, at)
    here = depth[keep] == b.length[row[keep]]
    rows = row[keep].tolist()
    told = [ends[r] if h else _EMPTY for r, h in zip(rows, here.tolist(), strict=True)]
    owner = [owners.get(r) if h else None for r, h in zip(rows, here.tolist(), strict=True)]
    n, m = len(keep), len(pieces)
    columns = [conv[keep], depth[keep], pa.array(parent[keep], mask=depth[keep] == 0), n_convs[keep], children[keep],
               leaves[keep], saved[keep]]
    out = [pa.concat_arrays([pa.array(c, pa.int64()), pa.nulls(m, pa.int64())]) for c in columns]
    out.append(pa.array(told + [None] * m, pa.string()))
    out.append(pa.array([None] * n + [number] * m, pa.int32()))
    out.append(pa.array([None] * n + [p for _, p in pieces], pa.string()))
    out.append(pa.array(owner + [o for o, _ in pieces], pa.int32()))
    return pa.table(out, names=[c.split()[0] for c in _NODE.split(", ")])


def _ends(b: Block, layout: Layout, at: int) -> tuple[list[str | None], dict[int, int], list[tuple[int, str]]]:
    """For each row that copies follow, or none, the digest of their ids, null where they go on in
    the next block; the owner of such a row; and the ids of copies that cross a border, by owner."""
    begin = np.flatnonzero(~b.copy)
    stop = np.append(begin, b.n)[1:]
    ends: list[str | None] = [None] * b.n
    ids = b.ids.tolist()
    for lo, hi in zip(begin.tolist(), stop.tolist(), strict=True):
        ends[lo] = hashlib.sha256(",".join(map(str, ids[lo:hi])).encode()).hexdigest()
    owners, pieces = {}, []
    lead = int(begin[0]) if len(begin) else b.n
    if lead:
        pieces.append((layout.origin(at), ",".join(map(str, ids[:lead]))))
    if len(begin) and at + 1 < len(layout.blocks) and layout.summaries[at + 1].copies:
        last = int(begin[-1])
        ends[last] = None
        owners[last] = layout.blocks[at]
        pieces.append((layout.blocks[at], ",".join(map(str, ids[last:]))))
    return ends, owners, pieces


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    owner, digest, done = None, None, []
    for batch in batches:
        for mine, ids in zip(batch["owner"].to_pylist(), batch["ends"].to_pylist(), strict=True):
            if mine != owner:
                if digest:
                    done.append((owner, digest.hexdigest()))
                owner, digest = mine, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if digest:
        done.append((owner, digest.hexdigest()))
    yield pa.record_batch([pa.array([o for o, _ in done], pa.int32()), pa.array([d for _, d in done], pa.string())],
                          names=["owner", "digest"])

"""Minimax contiguous sharding.

Equal texts form an atomic group.  Groups are ordered by the 64-bit hash of their text and cut into
contiguous shards; the smallest feasible capacity is found by binary search with a greedy check.

The driver first sees sizes by hash cell (``2**CELL_BITS`` of them).  With cells taken whole the search gives an
upper bound of the capacity, with cells taken as divisible a lower one; cells in which a cut may fall between the two
bounds are divided, 8 bits of hash at a time, until the bounds meet.  So the capacity is the smallest over
groups, and the driver holds some hundred times 256 further cells a round, whatever the input.

Null text has size 8 and groups with empty text.  Null ids are numbered like others.  Rows that repeat id and text
take slots one by one, in no stated order among themselves.  Many cuts may reach the capacity; the one nearest to
equal shares is taken, so the same rows give the same shards.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

CELL_BITS = 16
STEP_BITS = 8
LANES = 512


def fewest_shards(prefix: np.ndarray, capacity: int, limit: int) -> int:
    """Shards that greedy filling needs over the ordered groups; limit + 1 if more."""
    at, used = 0, 0
    while at < len(prefix) - 1:
        nxt = int(np.searchsorted(prefix, prefix[at] + capacity, "right")) - 1
        if nxt == at or used == limit:
            return limit + 1
        at, used = nxt, used + 1
    return used


def smallest_capacity(prefix: np.ndarray, shards: int) -> int:
    """By binary search with the greedy check."""
    low, high = max(int(np.diff(prefix).max(initial=0)), -(-int(prefix[-1]) // shards)), int(prefix[-1])
    while low < high:
        middle = (low + high) // 2
        if fewest_shards(prefix, middle, shards) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def minimax_cuts(sizes: np.ndarray, shards: int) -> np.ndarray:
    """First group of each shard after the first, at the smallest capacity that ``shards`` can hold.

    Many cuts reach that capacity; taken is the one nearest to equal shares of what is left.
    """
    prefix = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    low = smallest_capacity(prefix, shards)
    n = len(sizes)
    earliest = [n]  # where the last k shards may start at the earliest
    for _ in range(shards - 1):
        earliest.append(int(np.searchsorted(prefix, prefix[earliest[-1]] - low, "left")))
    cuts, at = [], 0
    for k in range(shards - 1, 0, -1):
        latest = int(np.searchsorted(prefix, prefix[at] + low, "right")) - 1
        goal = prefix[at] + (prefix[n] - prefix[at]) / (k + 1)
        near = int(np.searchsorted(prefix, goal))
        if near > at and goal - prefix[near - 1] <= prefix[min(near, n)] - goal:
            near -= 1
        at = max(min(max(near, earliest[k]), latest), at)
        cuts.append(at)
    return np.array(cuts, np.int64)


class Cells:
    """Ranges of hashes in order: first hash, bits that it fixes, bytes, and whether it is one group."""

    def __init__(self, start, depth, size, single):
        order = np.argsort(np.asarray(start, np.int64), kind="stable")
        self.start, self.depth, self.size = (np.asarray(x, np.int64)[order] for x in (start, depth, size))
        self.single = np.asarray(single, bool)[order]

    def divided(self, index: np.ndarray, parts: "Cells") -> "Cells":
        """With the cells at ``index`` replaced by their parts."""
        keep = np.ones(len(self.start), bool)
        keep[index] = False
        return Cells(*(np.concatenate([a[keep], b]) for a, b in ((self.start, parts.start), (self.depth, parts.depth), (self.size, parts.size), (self.single, parts.single))))


def open_cells(cells: Cells, shards: int) -> np.ndarray:
    """Cells to divide: those in which a greedy cut may fall at some capacity between the bounds."""
    prefix = np.concatenate([[0], np.cumsum(cells.size)]).astype(np.int64)
    total = int(prefix[-1])

    def reach(at: int, capacity: int, divisible: bool) -> int:
        """Where a shard that starts at byte ``at`` ends."""
        end = min(at + capacity, total)
        cell = int(np.searchsorted(prefix, end, "right")) - 1
        return end if cell == len(cells.size) or divisible and not cells.single[cell] else int(prefix[cell])

    def fits(capacity: int) -> bool:
        at = 0
        for _ in range(shards):
            at = reach(at, capacity, True)
        return at == total

    low, high = -(-total // shards), total
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    most = smallest_capacity(prefix, shards)
    if low >= most:
        return np.zeros(0, np.int64)
    first = last = 0
    chosen = np.zeros(len(cells.size), bool)
    for _ in range(shards):
        nxt = reach(first, low, False)
        if nxt <= first < total:  # a cell over the lower bound
            chosen[int(np.searchsorted(prefix, first, "right")) - 1] = True
            nxt = reach(first, low, True)
        first, last = nxt, reach(last, most, True)
        chosen |= (prefix[:-1] <= last) & (prefix[1:] >= first)
    return np.flatnonzero(chosen & ~cells.single)


def refined(cells: Cells, shards: int, divide) -> Cells:
    """Cells among whose bounds the best cuts over groups lie; ``divide`` gives the parts of the cells at an index."""
    while len(index := open_cells(cells, shards)):
        cells = cells.divided(index, divide(cells, index))
    return cells


def _counted(rows: DataFrame, depth: int) -> Cells:
    cell = F.shiftright("hash", 64 - depth) if depth < 64 else F.col("hash")
    found = rows.groupBy(cell.cast("long").alias("cell")).agg(F.sum("size").alias("size"), (F.min("hash") == F.max("hash")).alias("single")).toPandas()
    start = np.array([int(c) << (64 - depth) for c in found["cell"]], np.int64)
    return Cells(start, np.full(len(found), depth), found["size"].to_numpy(np.int64), found["single"].to_numpy(bool))


def _divide(small: DataFrame):
    def run(cells: Cells, index: np.ndarray) -> Cells:
        parts = []
        for depth in np.unique(cells.depth[index]).tolist():
            heads = (cells.start[index][cells.depth[index] == depth] >> (64 - depth)).tolist()
            names = F.broadcast(small.sparkSession.createDataFrame([(h,) for h in heads], "head long"))
            parts.append(_counted(small.join(names, F.shiftright("hash", 64 - depth) == F.col("head")), min(64, depth + STEP_BITS)))
        return Cells(*(np.concatenate([getattr(p, k) for p in parts]) for k in ("start", "depth", "size", "single")))

    return run


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", cell_bits: int = CELL_BITS) -> DataFrame:
    """``id_col``, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs``."""
    text = text_or_empty(text_col)
    small = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text).alias("hash"), F.pmod(F.xxhash64(F.lit(7), F.col(id_col)), F.lit(LANES)).cast("int").alias("lane"),
    )
    small = materialize(small, "sizes")
    cells = refined(_counted(small, cell_bits), shards, _divide(small))
    firsts = [int(cells.start[c]) for c in minimax_cuts(cells.size, shards) if c < len(cells.start)]  # shards behind the end are empty
    placed = small.withColumn("shard", sum((F.when(F.col("hash") >= F.lit(c).cast("long"), 1).otherwise(0) for c in firsts), F.lit(0)).cast("int")).drop("hash")

    # slots: lanes split a shard by id, so that no task numbers a whole shard
    lanes = placed.groupBy("shard", "lane").agg(F.count("*").alias("n"))
    first = lanes.select("shard", "lane", (F.sum("n").over(Window.partitionBy("shard").orderBy("lane")) - F.col("n")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("shard", "lane").orderBy("id", "crc", "size")) - 1
    return (
        placed.withColumn("rank", rank).join(F.broadcast(first), ["shard", "lane"])  # shards x LANES rows at most
        .select(
            F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
            (F.col("first") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )

"""Exact deduplication over an extendible-hash index kept in shared files.

1. Page writers (one per input partition) fold equal texts of their own partition into one entry
   with its row count and its winning row.  A text that fills a third of the table so gives one
   entry per partition.  Entries and the rows that point to them go to shared page files.
2. The directory starts with one bucket and doubles while a bucket is overfull.  It is computed from ``2**FIRST_DEPTH``
   prefix counts; prefixes that are still overfull are counted anew by longer ones, and the directory doubles
   further, to ``2**DEEPEST`` slots at most, 16 MB in the driver.  Beyond 32 TB of distinct text buckets grow with the
   input instead; owners read their buckets as a stream, so no size of a bucket is held in memory.
3. Owner tasks each take a contiguous range of keys, walk the entries in key order, chain the entries
   that share a 64-bit key, compare their bytes, and total each class.

Null text counts as empty.  Rows that repeat both id and text are one group in which one row stays.
A null id loses against any other id.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize, slices, text_or_empty

FIRST_DEPTH, DEEPEST = 14, 20
BUCKET_BYTES = 32 << 20
PAGE_BYTES = 48 << 20
_PAGES = "row long, id long, entry long, sha string, key long, bytes binary, n long, best_id long, best_row long"
_NO_ID = -(1 << 63)


def _write_pages(batches):
    """Rows, and after each ``PAGE_BYTES`` of distinct text the entries that they point to."""
    base = TaskContext.get().partitionId() << 36
    row = base
    entry = base
    page: dict[bytes, list] = {}
    held = 0

    def flush():
        items = list(page.items())
        for at in range(0, len(items), 512):
            part = items[at : at + 512]
            n = len(part)
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    none, none, pa.array([v[0] for _, v in part], pa.int64()), pa.nulls(n, pa.string()), pa.array([v[1] for _, v in part], pa.int64()),
                    pa.array([k for k, _ in part], pa.binary()), *(pa.array([v[i] for _, v in part], pa.int64()) for i in (2, 3, 4)),
                ],
                names=["row", "id", "entry", "sha", "key", "bytes", "n", "best_id", "best_row"],
            )
        page.clear()

    for piece in slices(batches):
        ids = piece.batch.column("id").fill_null(_NO_ID).to_pylist()
        keys = piece.batch.column("key").to_pylist()
        entries, rows = [], []
        for i in range(piece.n):
            text = piece.bytes(i)
            found = page.get(text)
            if found is None:
                found = page[text] = [entry, keys[i], 0, _NO_ID, -1]
                entry += 1
                held += len(text) + 200
            found[2] += 1
            if (ids[i], row) > (found[3], found[4]):
                found[3:] = ids[i], row
            entries.append(found[0])
            rows.append(row)
            row += 1
        none = pa.nulls(piece.n, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int64()), piece.batch.column("id"), pa.array(entries, pa.int64()), piece.batch.column("sha").cast(pa.string()), none, pa.nulls(piece.n, pa.binary()), none, none, none],
            names=["row", "id", "entry", "sha", "key", "bytes", "n", "best_id", "best_row"],
        )
        if held > PAGE_BYTES:
            yield from flush()
            held = 0
    yield from flush()


def build_directory(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Split buckets in two while one is over ``capacity``; a bucket that one prefix fills stays whole.

    ``sizes``: bytes by key prefix, a power of two long.  Gives each bucket's first prefix, its local
    depth, and the global depth (the directory has 2**depth slots).
    """
    depth_of_cells = len(sizes).bit_length() - 1
    total = np.concatenate([[0], np.cumsum(sizes)])
    depth = 0
    pending, done = [(0, 0)], []
    while pending:
        split = []
        for first, local in pending:
            width = 1 << (depth_of_cells - local)
            if total[first + width] - total[first] > capacity and local < depth_of_cells:
                split += [(first, local + 1), (first + width // 2, local + 1)]
            else:
                done.append((first, local))
        if split:
            depth += 1
        pending = split
    done.sort()
    return np.array([d[0] for d in done]), np.array([d[1] for d in done]), depth


def prefix_sizes(entries: DataFrame, first: int, deepest: int, capacity: int) -> np.ndarray:
    """Bytes of entries by key prefix; prefixes of ``first`` bits, lengthened while one holds more than ``capacity``."""

    def counted(rows, depth):
        cell = F.shiftrightunsigned("key", 64 - depth)
        return rows.groupBy(cell.alias("cell")).agg(F.sum(F.octet_length("bytes") + 64).alias("size")).toPandas()

    depth, sizes = first, np.zeros(1 << first, np.int64)
    found = counted(entries, depth)
    sizes[found["cell"].to_numpy(np.int64)] = found["size"].to_numpy(np.int64)
    while depth < deepest and len(full := np.flatnonzero(sizes > capacity)):
        names = F.broadcast(entries.sparkSession.createDataFrame(pa.table({"head": full})))  # total / capacity rows at most
        rows = entries.join(names, F.shiftrightunsigned("key", 64 - depth) == F.col("head"), "left_semi")
        sizes[full] = 0
        depth += 2
        wide = np.zeros(1 << depth, np.int64)
        wide[::4] = sizes  # what is not overfull stays together, at its first longer prefix
        found = counted(rows, depth)
        wide[found["cell"].to_numpy(np.int64)] += found["size"].to_numpy(np.int64)
        sizes = wide
    return sizes


def assign_owners(sizes: np.ndarray, firsts: np.ndarray, owners: int) -> np.ndarray:
    """Owner of each bucket: contiguous key ranges of about equal bytes."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    middle = (total[firsts] + total[np.append(firsts[1:], len(sizes))]) / 2
    return np.minimum((middle * owners / max(1, total[-1])).astype(int), owners - 1)


def _own(batches):
    """Entries in key order: chain equal keys, compare bytes, total each class."""
    key, chain = None, []

    def settle():
        out = [[], [], [], []]
        for _, entries, n, best in chain:
            for e in entries:
                for to, value in zip(out, (e, best[0], best[1], n)):
                    to.append(value)
        return out

    ready = [[], [], [], []]
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "entry", "bytes", "n", "best_id", "best_row")]
        for k, entry, data, n, best_id, best_row in zip(*columns):
            if k != key:
                for to, more in zip(ready, settle()):
                    to += more
                key, chain = k, []
            for link in chain:
                if link[0] == data:
                    link[1].append(entry)
                    link[2] += n
                    link[3] = max(link[3], (best_id, best_row))
                    break
            else:
                chain.append([data, [entry], n, (best_id, best_row)])
        if len(ready[0]) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ready], names=["entry", "keep", "keep_row", "size"])
            ready = [[], [], [], []]
    for to, more in zip(ready, settle()):
        to += more
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ready], names=["entry", "keep", "keep_row", "size"])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("key"), F.sha2(text, 256).alias("sha"))
    pages = materialize(rows.mapInArrow(_write_pages, _PAGES), "pages")
    entries = pages.filter("row is null").select("key", "entry", "bytes", "n", "best_id", "best_row")

    sizes = prefix_sizes(entries, FIRST_DEPTH, DEEPEST, BUCKET_BYTES)
    depth = len(sizes).bit_length() - 1
    cell = F.shiftrightunsigned("key", 64 - depth)
    firsts, _, _ = build_directory(sizes, BUCKET_BYTES)
    owners = owners or max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(firsts))
    # a bucket is a range of prefixes; small inputs still use all owners
    if len(firsts) < owners:
        firsts, _, _ = build_directory(sizes, max(1, int(sizes.sum()) // (4 * owners)))
    table = np.repeat(assign_owners(sizes, firsts, owners), np.diff(np.append(firsts, len(sizes))))
    # the directory: 2**DEEPEST slots of 12 bytes at most
    slots = F.broadcast(spark.createDataFrame(pa.table({"cell": np.arange(len(table)), "owner": table.astype(np.int32)})))
    keyed = entries.withColumn("cell", cell).join(slots, "cell").repartitionById(owners, "owner").drop("cell", "owner")
    classes = keyed.sortWithinPartitions("key", "entry").mapInArrow(_own, "entry long, keep long, keep_row long, size long")
    keep = F.when(F.col("keep") != _NO_ID, F.col("keep"))
    return (
        pages.filter("row is not null").select("row", "id", "entry", "sha").join(classes, "entry")
        .select(F.col("id").alias(id_col), keep.alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts: the one with the largest id.

    Rows are known by id and text, so an id that repeats with another text neither saves nor drops that row.
    """
    kept_id, kept_sha, sha, nth = (free_name(docs, n) for n in ("__kept_id", "__kept_sha", "__sha", "__nth"))
    kept = exact_groups(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias(kept_id), F.col("text_sha256").alias(kept_sha)).distinct()
    marked = docs.withColumn(sha, F.sha2(text_or_empty(text_col), 256))
    same = Window.partitionBy(id_col, sha).orderBy(F.lit(0))
    return (
        marked.join(kept, marked[id_col].eqNullSafe(kept[kept_id]) & (marked[sha] == kept[kept_sha]), "left_semi")
        .withColumn(nth, F.row_number().over(same)).filter(F.col(nth) == 1).select(docs.columns)
    )

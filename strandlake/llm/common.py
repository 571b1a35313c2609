"""Helpers shared by the training-data operators.

Tables that several steps read are written to the shared folder named by ``spark.checkpoint.dir``
(any Hadoop file system), never to a machine-local one, so a lost executor costs recomputation of
single tasks only.  Python steps work on slices of a few MB of text, whatever the batch size.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; in local mode a folder of our own where none is configured."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="strandlake-")
        atexit.register(shutil.rmtree, _own[app], True)
    return "file://" + _own[app]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


# ---- vectorised text access --------------------------------------------------------------

_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True


def _splitmix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SYMBOL = _splitmix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_powers = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, cached and grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(10, (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(size, np.uint64)
            done = 1
            while done < size:
                p[done : 2 * done] = p[:done] * np.uint64(pow(b, done, 1 << 64))
                done *= 2
            out.append(p)
        have = _powers[base] = tuple(out)
    return have


def range_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hash of symbols[start:end] for every pair, from one prefix sum of 64-bit symbols."""
    up, down = powers(base, len(symbols) + 1)
    prefix = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up[: len(symbols)], out=prefix[1:])
    return _splitmix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Slice:
    """Some whole documents of a batch: raw UTF-8 ``data`` and ``offsets`` of each document in it."""

    def __init__(self, batch: pa.RecordBatch, text: str = "text"):
        self.batch = batch
        col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string()).fill_null("")
        buffers = col.buffers()
        offsets = np.frombuffer(buffers[1], np.int64)[col.offset : col.offset + len(col) + 1]
        raw = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and len(col) else np.zeros(0, np.uint8)
        self.data = raw[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.n = len(col)

    def column(self, name: str) -> np.ndarray:
        return self.batch.column(self.batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)

    def bytes(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs without ASCII white space; first word of each document."""
        if not len(self.data):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(self.n + 1, np.int64)
        solid = ~_WS[self.data]
        begins, finishes = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        finishes[:-1] &= ~solid[1:]
        lengths = np.diff(self.offsets)
        first = self.offsets[:-1][lengths > 0]
        last = self.offsets[1:][lengths > 0] - 1
        begins[first] = solid[first]
        finishes[last] = solid[last]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        data = self.data
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        return range_hashes(_SYMBOL[data], starts, ends)


def slices(batches, text: str = "text", limit: int = SLICE_BYTES):
    """Cut Arrow batches into slices of about ``limit`` bytes of text, at least one document each."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        sizes = np.cumsum(np.asarray(pc.binary_length(col).fill_null(0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(sizes, before + limit, "right")))
            yield Slice(batch.slice(at, stop - at), text)
            at = stop


def blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Binary column whose item i holds the bytes of values[cuts[i]:cuts[i+1]]."""
    flat = np.ascontiguousarray(values)
    width = flat.dtype.itemsize
    return pa.Array.from_buffers(
        pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(np.ascontiguousarray(cuts, np.int64) * width), pa.py_buffer(flat.view(np.uint8))]
    ).cast(pa.binary())

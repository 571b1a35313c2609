"""Column expressions over Phred+33 quality strings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sequence import byte_values, mean_byte

TOP = 93
#: fixed values: lower bound of a class -> its value, as a reader of the archive sees it
MODES = {
    "illumina_bin": [(0, 6), (20, 15), (30, 22), (40, 27), (50, 33), (60, 37), (70, 40)],
    "illumina_bin_std": [(0, 0), (2, 6), (10, 15), (20, 22), (25, 27), (30, 33), (35, 37), (40, 40)],
    "four_level": [(0, 6), (10, 15), (20, 25), (30, 37)],
    "binary": [(0, 10), (20, 40)],
    "discard": [(0, 0)],
}
#: fixed values: first step of the two-step binning, by decade
QUANTIZED = [(0, 0), (10, 6), (20, 15), (30, 22), (40, 27), (50, 33), (60, 37), (70, 40)]
#: fixed values: cutoffs of the bin codes, their values when decoded, and bits a code
CODES = {
    "illumina8": ([2, 10, 20, 25, 30, 35, 40], [6, 6, 15, 22, 27, 33, 37, 40], 3),
    "binary": ([20], [10, 40], 1),
    "four_level": ([10, 20, 30], [6, 15, 25, 37], 2),
    "none": (None, None, 7),
}


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _value(table, q: int) -> int:
    return [v for low, v in table if q >= low][-1]


def phred(quality) -> Column:
    """Array of scores, at least 0."""
    return F.transform(byte_values(quality), lambda x: F.greatest(x - 33, F.lit(0)))


def _remap(quality, table) -> Column:
    source = "".join(chr(33 + q) for q in range(TOP + 1))
    return F.translate(_c(quality), source, "".join(chr(33 + _value(table, q)) for q in range(TOP + 1)))


def quantize(quality, mode: str) -> Column:
    """Quality string after a lossy round trip; ``lossless`` leaves it alone."""
    if mode == "lossless":
        return _c(quality)
    if mode not in MODES:
        raise ValueError(f"quality mode {mode!r}")
    return _remap(quality, MODES[mode])


def quantize_by_decade(quality) -> Column:
    return _remap(quality, QUANTIZED)


def threshold(quality, at: int, high: int, low: int) -> Column:
    """Two-level quality; needs low <= at <= high."""
    if not low <= at <= high:
        raise ValueError("low <= threshold <= high")
    return _remap(quality, [(0, low), (at, high)] if at else [(0, high)])


def bin_codes(quality, kind: str) -> Column:
    """Array of codes."""
    cuts, _, _ = CODES[kind]
    if cuts is None:
        return F.transform(phred(quality), lambda q: F.least(q, F.lit(127)))
    return F.transform(phred(quality), lambda q: sum((F.when(q >= c, 1).otherwise(0) for c in cuts), F.lit(0)))


def bin_values(codes, kind: str) -> Column:
    """Quality string of codes."""
    _, values, _ = CODES[kind]
    if values is None:
        return F.array_join(F.transform(_c(codes), lambda c: F.char(c + 33)), "")
    table = F.array(*[F.lit(chr(33 + v)) for v in values])
    return F.array_join(F.transform(_c(codes), lambda c: F.get(table, c)), "")


def packed_size(quality, kind: str) -> Column:
    """Bytes of the packed codes of a read."""
    return F.ceil(F.length(_c(quality)) * CODES[kind][2] / 8).cast("int")


def pack_codes(kind: str):
    bits = CODES[kind][2]

    @F.pandas_udf(T.BinaryType())
    def pack(codes: pd.Series) -> pd.Series:
        import numpy as np

        def one(c):
            if c is None:
                return None
            flat = ((np.asarray(c, np.uint8)[:, None] >> np.arange(bits, dtype=np.uint8)) & 1).ravel()
            return np.packbits(flat, bitorder="little").tobytes()

        return codes.map(one)

    return pack


def unpack_codes(kind: str):
    bits = CODES[kind][2]

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def unpack(packed: pd.Series, length: pd.Series) -> pd.Series:
        import numpy as np

        def one(data, n):
            flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: int(n) * bits].reshape(-1, bits)
            return (flat.astype(np.int32) << np.arange(bits)).sum(1).tolist()

        return pd.Series([None if d is None else one(d, n) for d, n in zip(packed, length)])

    return unpack


def mean_quality(quality) -> Column:
    """Integer mean of the ASCII codes."""
    return mean_byte(quality)


def error_probability(q) -> Column:
    return F.pow(F.lit(10.0), -_c(q) / 10.0)


def position_bin(pos, width: int = 5, most: int = 63) -> Column:
    return F.least(F.floor(_c(pos) / width), F.lit(most)).cast("int")


def relative_bin(pos, length, bins: int = 20) -> Column:
    return F.least(F.floor(_c(pos) * bins / _c(length)), F.lit(bins - 1)).cast("int")


def simple_position_bin(pos) -> Column:
    """Exact below 8, then 8 + pos / 8, six bits."""
    p = _c(pos)
    return F.least(F.when(p < 8, p).otherwise(8 + F.floor(p / 8)), F.lit(63)).cast("int")


def run_lengths(quality, letter: str = "F") -> Column:
    """Array of (run, breaker): how many times the letter stands before each other letter; a last run has no breaker."""
    parts = F.regexp_extract_all(F.concat(_c(quality), F.lit("\n")), F.lit(f"({letter}*)([^{letter}])"), F.lit(0))
    runs = F.transform(parts, lambda p: F.struct((F.length(p) - 1).alias("run"), F.when(F.right(p, F.lit(1)) != "\n", F.right(p, F.lit(1))).alias("breaker")))
    return F.filter(runs, lambda r: (r["run"] > 0) | r["breaker"].isNotNull())


def read_window(partition: str | None = None) -> Window:
    """Bases of a read in order; over the exploded table (read_idx, pos, ...)."""
    return Window.partitionBy(*( [partition] if partition else []), "read_idx").orderBy("pos")

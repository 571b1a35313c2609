"""Columns of aligned reads: transposes, consensus, residuals and interleaving."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from . import blocks

_CODE = "ACGT"
#: of a base or of a step's digit; 4 of all else
_VALUES = np.full(256, 4, np.uint8)
_VALUES[np.frombuffer(b"ACGT0123", np.uint8)] = [0, 1, 2, 3] * 2


def transpose(bases: DataFrame, column: str = "base") -> DataFrame:
    """(pos, block, values): a column's values in read order, in blocks of 65,536 reads."""
    block = F.floor(F.col("read_idx") / 65536)
    return bases.groupBy("pos", block.alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("read_idx", column))), lambda x: x[column]).alias("values"))


def column_consensus(bases: DataFrame, by: tuple[str, ...] = ("pos",), ties: str = "last") -> DataFrame:
    """(by..., base, n): the commonest of A, C, G, T; of ties the last letter, or the first."""
    counts = bases.filter(F.col("base").isin(*_CODE)).groupBy(*by, "base").agg(F.count("*").alias("n"))
    order = F.col("base").desc() if ties == "last" else F.col("base").asc()
    w = Window.partitionBy(*by).orderBy(F.col("n").desc(), order)
    return counts.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def code(base):
    """A0 C1 G2 T3."""
    return F.instr(F.lit(_CODE), base) - 1


def residual(bases: DataFrame, consensus: DataFrame, by: tuple[str, ...] = ("pos",)) -> DataFrame:
    """(read_idx, pos, residual): 0 where the base is the consensus, else 1 to 3.  The consensus has a row for each column
    of the reads, so it is sent to the bases."""
    c = consensus.select(*by, F.col("base").alias("top"))
    step = F.pmod(code(F.col("base")) - code(F.col("top")), F.lit(4))
    return bases.filter(F.col("base").isin(*_CODE)).join(F.broadcast(c), list(by)).select("read_idx", "pos", step.cast("int").alias("residual"))


def best_shift(reads: DataFrame, reference_idx: int, k: int = 12, least: int = 1) -> DataFrame:
    """(read_idx, shift, votes): position in the reference read minus position in the read, by votes of shared
    k-mers; of equal votes the smallest shift."""
    kmers = reads.select("read_idx", F.explode(S.kmers("sequence", k)).alias("x")).select("read_idx", "x.pos", "x.kmer").filter(~F.col("kmer").contains("N"))
    ref = kmers.filter(F.col("read_idx") == reference_idx).groupBy("kmer").agg(F.min("pos").alias("ref_pos"))
    votes = kmers.join(F.broadcast(ref), "kmer").groupBy("read_idx", (F.col("ref_pos") - F.col("pos")).alias("shift")).agg(F.count("*").alias("votes"))  # k-mers of one read
    w = Window.partitionBy("read_idx").orderBy(F.col("votes").desc(), "shift")
    return votes.filter(F.col("votes") >= least).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def shifted(bases: DataFrame, shifts: DataFrame) -> DataFrame:
    """Bases with ``column``: position plus the read's shift, from 0."""
    low = shifts.agg(F.min("shift").alias("low"))
    return bases.join(shifts.select("read_idx", "shift"), "read_idx").crossJoin(F.broadcast(low)).withColumn("column", F.col("pos") + F.col("shift") - F.col("low")).drop("low")  # one row


def shift_residual(bases: DataFrame, shifts: DataFrame) -> DataFrame:
    """(read_idx, column, residual) against the consensus of the reads that cover a column."""
    rows = shifted(bases, shifts).select("read_idx", F.col("column").alias("pos"), "base")
    return residual(rows, column_consensus(rows)).withColumnRenamed("pos", "column")


def _down_columns(rows: DataFrame, text: str, block: int, own, before: Column, run, out: str, mod4: bool = True) -> DataFrame:
    """A pass down the columns of texts (read_idx, place, ``text``) by read_idx, then place, then the text: (read_idx,
    place, ``out``).

    Packed reads go by as a stream of blocks of ``block`` read numbers.  ``own(values, cuts)`` gives one number for each
    column of a block and ``before``, over (pos, __block, value), what the earlier blocks make of it; ``run(values,
    cuts, before)`` has the values of a block's columns one after another, each in the order of the reads.  Values are
    bytes from 0 to 3, whose sums wrap at a multiple of 4, and other letters N; without ``mod4`` every letter counts.
    """
    # reads without a number come first, as in a sort
    at = F.coalesce(F.floor(F.col("read_idx") / block), F.lit(-(1 << 62)))
    packed = blocks.pack(rows, at, ["read_idx", "place", text])

    def columns(table):
        reads = blocks.rows(table.column("payload").to_pylist()).sort_by([("read_idx", "ascending"), ("place", "ascending"), (text, "ascending")])
        texts = reads.column(text).combine_chunks().cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        letters = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
        ends = ends - ends[0]
        if len(letters) and letters.max() > 127:  # letters of several bytes
            ends = np.append(0, np.cumsum(pc.utf8_length(texts).to_numpy()))
            letters = np.frombuffer(letters.tobytes().decode().encode("utf-32-le"), np.uint32)
        values = _VALUES[np.minimum(letters, 255)] if mod4 else letters
        known = np.flatnonzero(values < 4) if mod4 else np.arange(len(letters))
        pos = (np.arange(len(letters)) - np.repeat(ends[:-1], np.diff(ends)))[known].astype(np.int32)
        order = blocks.ordered(pos, [])
        return reads, ends, known[order], values[known[order]], pos[order]

    def summary(table: pa.Table) -> pa.Table:
        _, _, _, values, pos = columns(table)
        cuts = blocks.starts(pos)
        first = cuts[:-1]
        return pa.table({"__block": pa.repeat(table.column("block")[0], len(first)), "pos": pa.array(pos[first], pa.int64()), "value": pa.array(own(values, cuts), pa.int64())})

    def whole(table: pa.Table, earlier: pa.Table) -> pa.Table:
        reads, ends, known, values, pos = columns(table)
        letters = np.full(ends[-1], ord("N"), values.dtype)
        # the summary has the columns of this block, no others
        letters[known] = run(values, blocks.starts(pos), earlier.sort_by("pos").column("value").to_numpy())
        numbers, rank = reads.column("read_idx"), np.arange(len(reads))
        same = np.append(False, pc.fill_null(pc.equal(numbers[1:], numbers[:-1]), False).to_numpy())
        missing = numbers.is_null().to_numpy()
        same[1:] |= missing[1:] & missing[:-1]
        place = rank - np.maximum.accumulate(np.where(same, 0, rank))
        if letters.dtype == np.uint8:
            texts = pa.LargeStringArray.from_buffers(len(reads), pa.py_buffer(ends), pa.py_buffer(letters)).cast(pa.string())
        else:
            joint = letters.tobytes().decode("utf-32-le")
            texts = pa.array([joint[low:high] for low, high in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.string())
        return pa.table({"read_idx": numbers, "place": pa.array(place, pa.int64()), out: texts})

    ends = packed.groupBy("block").applyInArrow(summary, "__block long, pos long, value long")
    earlier = ends.select("__block", "pos", before.alias("value"))
    return packed.groupBy("block").cogroup(earlier.groupBy("__block")).applyInArrow(whole, f"read_idx long, place long, {out} string")


def mod4_delta(reads: DataFrame, block: int = 16384) -> DataFrame:
    """(read_idx, place, steps): each base's step from the base before it in its column, modulo 4, the first from A; N
    where a read has no base.  ``place`` tells reads of one read_idx apart, in the order of their letters."""

    def run(values, cuts, before):
        last = np.empty_like(values)
        last[1:] = values[:-1]
        last[cuts[:-1]] = before
        return ((values - last) & 3) + ord("0")

    rows = reads.select("read_idx", F.lit(0).cast("long").alias("place"), F.coalesce(F.regexp_replace("sequence", f"[^{_CODE}]", "N"), F.lit("")).alias("sequence"))
    w = Window.partitionBy("pos").orderBy("__block")
    return _down_columns(rows, "sequence", block, lambda values, cuts: values[cuts[1:] - 1], F.lag("value", 1, 0).over(w), run, "steps")


def mod4_undelta(steps: DataFrame, block: int = 16384) -> DataFrame:
    """(read_idx, place, sequence): the bases from the steps of ``mod4_delta``, by running sums down the columns."""

    def run(values, cuts, before):
        first = cuts[:-1]
        sums = np.cumsum(values, dtype=np.uint8)
        sums += np.repeat(before.astype(np.uint8) - sums[first] + values[first], np.diff(cuts))
        return np.frombuffer(_CODE.encode(), np.uint8)[sums & 3]

    w = Window.partitionBy("pos").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    return _down_columns(steps, "steps", block, lambda values, cuts: np.add.reduceat(values, cuts[:-1], dtype=np.uint8) & 3, F.coalesce(F.pmod(F.sum("value").over(w), F.lit(4)), F.lit(0)), run, "sequence")


def by_base(texts: DataFrame, column: str, name: str) -> DataFrame:
    """(read_idx, pos, ``name``): a row for each letter of a read's text."""
    return texts.filter(F.length(column) > 0).select("read_idx", F.posexplode(F.split(column, "")).alias("pos", name))


def previous_base_delta(reads: DataFrame, block: int = 16384) -> DataFrame:
    """(read_idx, place, deltas): the bases, or ``0`` where the previous read of the column has the same; ``place`` as in
    ``mod4_delta``."""

    def run(values, cuts, before):
        last = np.empty(len(values), np.int64)
        last[1:] = values[:-1]
        last[cuts[:-1]] = before
        return np.where(last == values, ord("0"), values)

    rows = reads.select("read_idx", F.lit(0).cast("long").alias("place"), F.coalesce("sequence", F.lit("")).alias("sequence"))
    w = Window.partitionBy("pos").orderBy("__block")
    return _down_columns(rows, "sequence", block, lambda values, cuts: values[cuts[1:] - 1], F.lag("value", 1, -1).over(w), run, "deltas", mod4=False)


def above(reads: DataFrame, block: int, start: str = "S") -> DataFrame:
    """Reads (read_idx, sequence) with ``up``: beside each base that of the latest earlier read of its block of reads
    that has the column, ``start`` where there is none."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("read_idx")
        up, before = [], ""
        for text in table.column("sequence").to_pylist():
            up.append(before[: len(text)] + start * (len(text) - len(before)))
            before = text + before[len(text) :]
        return table.select(["read_idx", "sequence"]).append_column("up", pa.array(up, pa.string()))

    rows = reads.filter(F.length("sequence") > 0).select("read_idx", "sequence", F.floor(F.col("read_idx") / block).alias("block"))
    return rows.groupBy("block").applyInArrow(run, "read_idx long, sequence string, up string")


def interleave(bases: DataFrame, rows: int, order: str = "read_idx") -> DataFrame:
    """(cluster, pos, row, base, new_pos within the cluster): ``rows`` neighbours position by position."""
    w = Window.partitionBy("cluster").orderBy("pos", "row")
    placed = bases.withColumn("cluster", F.floor(F.col(order) / rows)).withColumn("row", F.col(order) % rows)
    return placed.select("cluster", "pos", "row", "base", (F.row_number().over(w) - 1).alias("new_pos"))


def rank_by_position(bases: DataFrame, lengths: DataFrame, bins: int = 5, k: int = 2) -> DataFrame:
    """(read_idx, pos, rank): rank of a base after its k previous bases within a relative position bin."""
    return _ranked(bases, lengths, k, F.least(F.floor(F.col("pos") * bins / F.col("length")), F.lit(bins - 1)).cast("int"))


def rank_mixed_order(bases: DataFrame, k: int) -> DataFrame:
    """As many previous bases as there are, up to k; position 0 has none."""
    return _ranked(bases, None, k, F.lit(0))


def _ranked(bases, lengths, k, bin_):
    """``bases`` may have ``context``, the k bases before, which is otherwise taken from a window over each read.  The
    table of ranks has a row for each bin, context and base; up to 5 letters before it is sent to the bases."""
    rows = bases
    if "context" not in bases.columns:
        w = Window.partitionBy("read_idx").orderBy("pos").rowsBetween(-k, -1)
        rows = bases.withColumn("context", F.array_join(F.collect_list("base").over(w), ""))
    rows = (rows.join(lengths, "read_idx") if lengths is not None else rows).withColumn("bin", bin_)
    counts = rows.groupBy("bin", "context", "base").agg(F.count("*").alias("n"))
    ranks = counts.withColumn("rank", F.row_number().over(Window.partitionBy("bin", "context").orderBy(F.col("n").desc(), "base")) - 1).drop("n")
    return rows.join(F.broadcast(ranks) if k <= 5 else ranks, ["bin", "context", "base"]).select("read_idx", "pos", "rank")

"""Differences against earlier reads and within columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quality as Q
from ..functions import sequence as S
from . import blocks
from .kmers import strings

#: fixed values: codes of a changed base; 0 stands for an equal one
DELTA_CODES = {"A": 1, "C": 2, "G": 3, "T": 4, "N": 5}
NO_PREVIOUS = 30


def _delta(now, before):
    """String of codes: 0 where the previous read has the same base."""
    code = F.translate(F.upper(now), "".join(DELTA_CODES), "".join(map(str, DELTA_CODES.values())))

    def one(x):
        at = F.when(F.length(x["now"]) > 0, F.sequence(F.lit(1), F.length(x["now"]))).otherwise(F.array().cast("array<int>"))
        letter = lambda c, i: F.substring(x[c], i, F.lit(1))
        return F.array_join(F.transform(at, lambda i: F.when(letter("now", i) == letter("before", i), F.lit("0")).otherwise(letter("code", i))), "")

    return S.let(F.struct(now.alias("now"), F.coalesce(before, F.lit("")).alias("before"), code.alias("code")), one)


def inline_delta(reads: DataFrame, chunk: int = 2_500_000, least: float = 0.6) -> DataFrame:
    """(read_idx, base_idx, delta): each read against the latest earlier read of its chunk with the same
    smallest syncmer, when both have one length and agree on more than ``least`` of their bases; else base_idx is
    null and delta the sequence.  An as-of self-join written as a window."""
    keyed = reads.select("read_idx", "sequence", F.floor(F.col("read_idx") / chunk).alias("chunk_id"), S.min_syncmer("sequence")["hash"].alias("h"))
    # reads without a syncmer have no earlier one: spread them, so that they are no hot key
    w = Window.partitionBy("chunk_id", "h", F.when(F.col("h").isNull(), F.col("read_idx"))).orderBy("read_idx")
    rows = keyed.withColumn("before", F.lag("sequence").over(w)).withColumn("before_idx", F.lag("read_idx").over(w))
    same = F.length("sequence") - F.size(S.mismatches("sequence", "before"))
    near = F.col("before").isNotNull() & F.col("h").isNotNull() & (F.length("sequence") == F.length("before")) & (same > least * F.length("sequence"))
    return rows.select("read_idx", F.when(near, F.col("before_idx")).alias("base_idx"), F.when(near, _delta(F.col("sequence"), F.col("before"))).otherwise(F.col("sequence")).alias("delta"))


def previous_read_delta(reads: DataFrame, order: str = "read_idx", chunk: int = 2_500_000) -> DataFrame:
    """(chunk_id, order, read_idx, delta): each read against the one before it in the chunk."""
    keyed = reads.withColumn("chunk_id", F.floor(F.col(order) / chunk))
    before = F.lag("sequence").over(Window.partitionBy("chunk_id").orderBy(order))
    return keyed.select("chunk_id", *dict.fromkeys([order, "read_idx"]), _delta(F.col("sequence"), before).alias("delta"))


def _undo(code: str, before: str) -> str:
    letters = {str(v): k for k, v in DELTA_CODES.items()}
    return "".join(before[i] if c == "0" else letters.get(c, c) for i, c in enumerate(code))


def _in_order(rows: DataFrame, order: str, decode, schema: str, beside: Sequence[str] = ()) -> DataFrame:
    """``decode`` each chunk's rows in order as a stream: what it keeps from batch to batch is the last read only.  Texts
    ``beside`` go by unchanged."""

    def run(batches):
        at, before = None, None
        for batch in batches:
            chunk = batch.column("chunk_id").to_numpy()
            cuts = np.append(np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])), len(chunk)) if len(chunk) else np.zeros(1, np.int64)
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if chunk[low] != at:
                    at, before = chunk[low], None
                texts, before = decode(batch.column("data").slice(low, high - low), before)
                yield pa.RecordBatch.from_arrays([batch.column("read_idx").slice(low, high - low), pa.array(texts, pa.string()), *[batch.column(c).slice(low, high - low) for c in beside]], names=names)

    schema += "".join(f", {c} string" for c in beside)
    names = [f.split()[0] for f in schema.split(", ")]
    return rows.repartition("chunk_id").sortWithinPartitions("chunk_id", order).select("chunk_id", "read_idx", "data", *beside).mapInArrow(run, schema)


_LETTER = np.arange(256, dtype=np.uint8)
for _base, _code in DELTA_CODES.items():
    _LETTER[ord(str(_code))] = ord(_base)


def _undo_codes(codes, before):
    """Texts of a run of codes, and the last one.  Runs of one length are filled downwards as a matrix."""
    values = codes.to_pylist()
    size = len(values[0])
    if any(len(v) != size for v in values) or size == 0 or not all(v.isascii() for v in values) or before is not None and len(before) < size:
        out = []
        for code in values:
            before = _undo(code, before or "")
            out.append(before)
        return out, before
    grid = np.frombuffer("".join(values).encode(), np.uint8).reshape(-1, size)
    above = np.frombuffer((before or "").ljust(size, "0")[:size].encode("latin-1"), np.uint8)
    grid = np.concatenate([above[None], np.where(grid == 48, 48, _LETTER[grid])])
    known = np.where(grid != 48, np.arange(len(grid))[:, None], 0)
    known[0] = 0
    filled = np.take_along_axis(grid, np.maximum.accumulate(known, axis=0), 0)[1:]
    out = [r.tobytes().decode() for r in filled]
    return out, out[-1]


def undo_previous_read_delta(deltas: DataFrame, order: str = "read_idx") -> DataFrame:
    """(read_idx, sequence); a chunk is decoded in order as a stream."""
    return _in_order(deltas.withColumnRenamed("delta", "data"), order, _undo_codes, "read_idx long, sequence string")


def undo_inline_delta(deltas: DataFrame, chunk: int = 2_500_000) -> DataFrame:
    """(read_idx, sequence)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        done: dict[int, str] = {}
        pdf = pdf.sort_values("read_idx")
        for i, base, code in zip(pdf["read_idx"], pdf["base_idx"], pdf["delta"]):
            done[i] = code if pd.isna(base) else _undo(code, done[int(base)])
        return pd.DataFrame({"read_idx": list(done), "sequence": list(done.values())})

    return deltas.withColumn("chunk_id", F.floor(F.col("read_idx") / chunk)).groupBy("chunk_id").applyInPandas(run, "read_idx long, sequence string")


def _scores(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Scores of all qualities, one after another, and where each starts, with the end; null is empty."""
    raw, offsets = strings(texts)
    if len(raw) and raw.max() > 127:  # characters, not bytes
        values = texts.fill_null("").to_pylist()
        return np.maximum(np.array([ord(c) for t in values for c in t], np.int32) - 33, 0), np.cumsum([0, *map(len, values)])
    return np.maximum(raw.astype(np.int32) - 33, 0), offsets


def _places(offsets: np.ndarray) -> np.ndarray:
    return np.arange(offsets[-1]) - np.repeat(offsets[:-1], np.diff(offsets))


def _lists(values: np.ndarray, offsets: np.ndarray, like: pa.Array) -> pa.Array:
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))
    return pc.if_else(like.is_null(), pa.scalar(None, lists.type), lists) if like.null_count else lists


def _differences(now: pa.Array, before: pa.Array) -> pa.Array:
    q, offsets = _scores(now)
    p, starts = _scores(before)
    at = _places(offsets)
    row = np.repeat(np.arange(len(now)), np.diff(offsets))
    has = at < np.diff(starts)[row]
    base = np.full(len(q), NO_PREVIOUS, np.int32)
    base[has] = p[starts[row[has]] + at[has]]
    first = np.asarray(before.is_null())[row]
    return _lists(np.where(first, q, np.clip(q - base, -128, 127)), offsets, now)


def with_quality_delta(rows: DataFrame, name: str) -> DataFrame:
    """Rows of (chunk_id, read_idx, quality, ...) with the scores of a chunk's first read, then differences from the read
    before it; positions that it lacks count as 30; clamped to a signed byte."""
    rows = rows.withColumn("__before", F.lag("quality").over(Window.partitionBy("chunk_id").orderBy("read_idx")))
    return rows.withColumn(name, F.arrow_udf(_differences, "array<int>")("quality", "__before")).drop("__before")


def quality_delta(reads: DataFrame, chunk: int = 2_500_000) -> DataFrame:
    """(chunk_id, read_idx, deltas) of ``with_quality_delta``."""
    rows = reads.select("read_idx", F.floor(F.col("read_idx") / chunk).alias("chunk_id"), "quality")
    return with_quality_delta(rows, "deltas").select("chunk_id", "read_idx", "deltas")


def _undo_scores(deltas, before):
    """Texts of a run of score differences, and the last scores.  Runs of one length are summed as a matrix."""
    offsets = deltas.offsets.to_numpy()
    values = deltas.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64)
    sizes = np.diff(offsets)
    text = lambda q: (q + 33).astype(np.uint8).tobytes().decode()
    if len(set(sizes.tolist())) == 1 and sizes[0] and (before is None or len(before) >= sizes[0]):
        grid = np.cumsum(values.reshape(len(sizes), -1), axis=0) + (0 if before is None else before[: sizes[0]])
        if grid.min() >= 0 and grid.max() <= 93:
            return [text(q) for q in grid], grid[-1]
    out = []
    for d in np.split(values, np.cumsum(sizes)[:-1]):
        base = np.zeros(len(d), np.int64)
        if before is not None:
            base += NO_PREVIOUS
            base[: len(before)] = before[: len(d)]
        before = np.clip(d + base, 0, 93)
        out.append(text(before))
    return out, before


def undo_quality_delta(deltas: DataFrame, beside: Sequence[str] = ()) -> DataFrame:
    """(read_idx, quality) and the texts ``beside``; a chunk is decoded in order as a stream."""
    return _in_order(deltas.withColumnRenamed("deltas", "data"), "read_idx", _undo_scores, "read_idx long, quality string", beside)


def quality_delta_stats(reads: DataFrame, chunk: int = 2_500_000) -> DataFrame:
    """One row over all but the chunks' first reads: n, zeros, small (1 to 3), largest absolute difference."""
    rows = quality_delta(reads, chunk).filter(F.col("read_idx") % chunk != 0).select(F.explode("deltas").alias("d"))
    a = F.abs("d")
    return rows.agg(F.count("*").alias("n"), F.sum(F.when(a == 0, 1).otherwise(0)).alias("zeros"), F.sum(F.when(a.between(1, 3), 1).otherwise(0)).alias("small"), F.max(a).alias("largest"))


def quality_model(reads: DataFrame) -> DataFrame:
    """(pos, median) up to the commonest read length (the smallest of several): upper medians by position,
    from counts by position and score."""
    length = reads.groupBy(F.length("quality").alias("len")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "len").limit(1).select("len")

    def counted(batches):
        for batch in batches:
            q, offsets = _scores(batch.column(0))
            cells, n = np.unique(_places(offsets) << 21 | q, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((cells >> 21).astype(np.int32)), pa.array((cells & ((1 << 21) - 1)).astype(np.int32)), pa.array(n)], names=["pos", "q", "n"])

    cells = reads.select("quality").mapInArrow(counted, "pos int, q int, n long").groupBy("pos", "q").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("pos").orderBy("q"))
    all_ = F.sum("n").over(Window.partitionBy("pos"))
    medians = cells.withColumn("upto", upto).withColumn("all", all_).filter(F.col("upto") > F.floor(F.col("all") / 2)).groupBy("pos").agg(F.min("q").alias("median"))
    return medians.crossJoin(F.broadcast(length)).filter("pos < len").select("pos", "median")  # one row


def model_residual(reads: DataFrame, model: DataFrame) -> DataFrame:
    """(read_idx, pos, residual) against the model; beyond it its last median counts."""
    rows = reads.select("read_idx", F.posexplode(Q.phred("quality")).alias("pos", "q"))
    last = model.agg(F.max("pos").alias("last_pos"))
    at = rows.crossJoin(F.broadcast(last)).withColumn("model_pos", F.least("pos", "last_pos"))
    joined = at.join(model.select(F.col("pos").alias("model_pos"), "median"), "model_pos", "left")
    return joined.select("read_idx", "pos", F.greatest(F.lit(-128), F.least(F.lit(127), F.col("q") - F.coalesce("median", F.lit(NO_PREVIOUS)))).alias("residual"))


def undo_model_residual(residuals: DataFrame, model: DataFrame) -> DataFrame:
    """(read_idx, quality)."""
    last = model.agg(F.max("pos").alias("last_pos"))
    at = residuals.crossJoin(F.broadcast(last)).withColumn("model_pos", F.least("pos", "last_pos"))
    joined = at.join(model.select(F.col("pos").alias("model_pos"), "median"), "model_pos", "left")
    q = F.greatest(F.lit(0), F.least(F.lit(93), F.col("residual") + F.coalesce("median", F.lit(NO_PREVIOUS))))
    return joined.groupBy("read_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", q.alias("q")))), lambda x: F.char(x["q"] + 33)), "").alias("quality"))


def _medians(model: DataFrame) -> np.ndarray:
    """The model's medians; it has a row for each position of a read."""
    return np.array([r["median"] for r in model.orderBy("pos").collect()], np.int32)


def _expected(medians: np.ndarray, at: np.ndarray) -> np.ndarray:
    return medians[np.minimum(at, len(medians) - 1)] if len(medians) else np.full(len(at), NO_PREVIOUS, np.int32)


def model_residuals(quality: str, model: DataFrame) -> Column:
    """Array of ``model_residual`` of a read."""
    medians = _medians(model)

    def run(texts: pa.Array) -> pa.Array:
        q, offsets = _scores(texts)
        return _lists(np.clip(q - _expected(medians, _places(offsets)), -128, 127), offsets, texts)

    return F.arrow_udf(run, "array<int>")(quality)


def undo_model_residuals(residuals: str, model: DataFrame) -> Column:
    """The quality of an array of ``model_residuals``."""
    medians = _medians(model)

    def run(lists: pa.Array) -> pa.Array:
        values, sizes = lists.flatten().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        offsets = np.append(0, np.cumsum(sizes))
        raw = (np.clip(values + _expected(medians, _places(offsets)), 0, 93) + 33).astype(np.uint8)
        texts = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)).cast(pa.string())
        return pc.if_else(lists.is_null(), pa.scalar(None, pa.string()), texts) if lists.null_count else texts

    return F.arrow_udf(run, "string")(residuals)


def header_deltas(parsed: DataFrame, chunk: int = 2_500_000) -> DataFrame:
    """(chunk_id, read_idx, dx, dy) of (read_idx, x, y) against the read before; a chunk's first against 0."""
    rows = parsed.withColumn("chunk_id", F.floor(F.col("read_idx") / chunk))
    w = Window.partitionBy("chunk_id").orderBy("read_idx")
    return rows.select("chunk_id", "read_idx", (F.col("x") - F.lag("x", 1, 0).over(w)).alias("dx"), (F.col("y") - F.lag("y", 1, 0).over(w)).alias("dy"))


def header_undelta(deltas: DataFrame) -> DataFrame:
    w = Window.partitionBy("chunk_id").orderBy("read_idx").rowsBetween(Window.unboundedPreceding, 0)
    return deltas.select("read_idx", F.sum("dx").over(w).alias("x"), F.sum("dy").over(w).alias("y"))


def header_delta_bytes(deltas: DataFrame) -> DataFrame:
    """One row: reads, and bytes of their deltas: one code byte for four reads, more where a step is over 1."""
    small = (F.abs("dx") <= 1) & (F.abs("dy") <= 1)
    more = F.when(small, 0).otherwise(S.varint_size(S.zigzag("dx")) + S.varint_size(S.zigzag("dy")))
    return deltas.agg(F.count("*").alias("n"), (F.ceil(F.count("*") / 4) + F.sum(more)).alias("bytes"))


def model_row(model: DataFrame) -> DataFrame:
    """The positional model as one row: read length and medians in order."""
    return model.agg(F.count("*").cast("int").alias("read_length"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "median"))), lambda x: x["median"]).alias("medians"))


def model_table(row: DataFrame) -> DataFrame:
    """The (pos, median) table of a one-row model."""
    return row.select(F.posexplode("medians").alias("pos", "median"))


def dictionary_sample(reads: DataFrame, share: float = 0.1, least: int = 100) -> DataFrame:
    """Reads at equal steps, ``share`` of them but ``least`` where there are as many, to train a compression dictionary
    on: a sample by definition."""
    n = reads.count()
    most = min(max(math.ceil(n * share), least), n)
    step = n // max(most, 1) or 1
    return reads.filter((F.col("read_idx") % step == 0) & (F.col("read_idx") < step * most)).select("read_idx", "quality")


def prediction_residual(bases: DataFrame, context: list[str], symbol: str = "phred", block: int = 500_000, part: int = 8192) -> DataFrame:
    """(read_idx, pos, residual): symbol minus the commonest symbol so far in its context (the smallest of several, 0 at
    first) plus 128.  Counts start anew in each block of reads; within it they are carried from ``part`` reads to the
    next, so a task holds the rows of one part."""
    parts = -(-block // part)
    over = F.floor(F.col("read_idx") / block)
    at = (over * parts + F.floor(F.pmod(F.col("read_idx"), F.lit(block)) / part)).alias("__part")
    counts = bases.groupBy(over.alias("__block"), at, *context, F.col(symbol).cast("int").alias("__symbol")).agg(F.count("*").alias("n"))
    seen = blocks.counted_before(counts, "__block", "__part", [*context, "__symbol"])
    rows = bases.select("read_idx", "pos", *[F.col(c).alias(f"__c{i}") for i, c in enumerate(context)], F.col(symbol).cast("int").alias("__symbol"))
    seen = seen.select("__part", *[F.col(c).alias(f"__c{i}") for i, c in enumerate(context)], "__symbol", "n")
    names = [f"__c{i}" for i in range(len(context))]

    def run(tables, texts):
        r = tables["rows"]
        n = len(r["read_idx"])
        before = tables.get("seen", {c: np.zeros(0, np.int64) for c in (*names, "__symbol", "n")})
        group, groups = blocks.joint_codes([np.concatenate([r[c], before[c]]) for c in (names or ["__symbol"])]) if names else (np.zeros(n + len(before["n"]), np.int64), 1)
        letters, letter = np.unique(np.concatenate([r["__symbol"], before["__symbol"]]).astype(np.int64), return_inverse=True)
        counts = np.zeros((groups, len(letters)), np.int32)
        counts[group[n:], letter[n:]] = before["n"]
        order = blocks.ordered(group[:n], [r["read_idx"], r["pos"]])
        group, letter = group[:n][order], letter[:n][order]
        top = np.zeros(n, np.int64)
        width = max(1, (1 << 22) // len(letters))
        for low in range(0, n, width):
            g, s = group[low : low + width], letter[low : low + width]
            own = np.zeros((len(g), len(letters)), np.int32)
            own[np.arange(len(g)), s] = 1
            upto = np.cumsum(own, 0, dtype=np.int32) - own
            cuts = blocks.starts(g)
            first = np.repeat(cuts[:-1], np.diff(cuts))
            upto += counts[g] - upto[first]
            best = upto.argmax(1)  # of equal counts the smallest symbol
            top[low : low + width] = np.where(upto[np.arange(len(g)), best] > 0, letters[best], 0)
            low_g, high_g = g[0], g[-1] + 1
            counts[low_g:high_g] += np.bincount((g - low_g) * len(letters) + s, minlength=(high_g - low_g) * len(letters)).reshape(high_g - low_g, -1).astype(np.int32)
        return {"read_idx": r["read_idx"][order].astype(np.int64), "pos": r["pos"][order].astype(np.int32), "residual": (letters[letter] - top + 128).astype(np.int32)}

    packed = blocks.pack(rows, at, ["read_idx", "pos", *names, "__symbol"]).unionByName(blocks.pack(seen, F.col("__part"), [*names, "__symbol", "n"], "seen"))
    return blocks.by_block(packed, run, "read_idx long, pos int, residual int")

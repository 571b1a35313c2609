"""Long-form rows of a block of reads, packed where they are read and worked on together.

A row per base is wide and many; what is shuffled instead is one compressed Arrow message for a run of rows of a block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame

#: fixed value: rows that a packer holds
RUN = 1 << 18
#: fixed value: stands for null among numbers
NULL = -(1 << 40)


def _message(table: pa.Table) -> bytes:
    columns = []
    for c in table.columns:
        c = c.combine_chunks()
        if pa.types.is_string(c.type):
            c = c.dictionary_encode()
        elif pa.types.is_integer(c.type) and len(c) and not c.null_count:
            v = c.to_numpy()
            c = pa.array(v.astype(np.result_type(np.min_scalar_type(v.min()), np.min_scalar_type(v.max()))))
        columns.append(c)
    packed = pa.table(columns, names=table.column_names)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, packed.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(packed)
    return sink.getvalue().to_pybytes()


def pack(rows: DataFrame, block: Column, columns: Sequence[str | Column], label: str = "rows") -> DataFrame:
    """(block, label, payload): ``columns`` (numbers and texts) of consecutive rows of one block."""

    def run(batches):
        def payloads(held):
            table = pa.Table.from_batches(held).combine_chunks()
            at = table.column("__block").to_numpy()
            if (at[1:] < at[:-1]).any():
                order = np.argsort(at, kind="stable")
                table, at = table.take(pa.array(order)), at[order]
            table = table.drop_columns(["__block"])
            cuts = np.flatnonzero(np.append(np.append(True, at[1:] != at[:-1]), True))
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                yield pa.RecordBatch.from_arrays([pa.array([at[low]], pa.int64()), pa.array([label]), pa.array([_message(table.slice(low, high - low))], pa.binary())], names=["block", "label", "payload"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= RUN:
                yield from payloads(held)
                held, n = [], 0
        if n:
            yield from payloads(held)

    return rows.select(block.cast("long").alias("__block"), *columns).mapInArrow(run, "block long, label string, payload binary")


def _unpack(payloads: list[bytes], texts: dict[str, dict]) -> dict[str, np.ndarray]:
    """Columns as numbers; texts as codes, which ``texts`` gives."""
    parts: dict[str, list[np.ndarray]] = {}
    for payload in payloads:
        table = pa.ipc.open_stream(payload).read_all()
        for name, column in zip(table.column_names, table.columns):
            c = column.combine_chunks()
            if isinstance(c, pa.ChunkedArray):
                c = c.chunk(0)
            if pa.types.is_dictionary(c.type):
                known = texts.setdefault(name, {})
                codes = np.array([known.setdefault(t, len(known)) for t in [*c.dictionary.to_pylist(), None]], np.int32)
                v = codes[c.indices.fill_null(len(codes) - 1).to_numpy(zero_copy_only=False)]
            elif pa.types.is_boolean(c.type):
                v = c.fill_null(False).to_numpy(zero_copy_only=False).astype(np.int8)
            else:
                v = (c.cast(pa.int64()).fill_null(NULL) if c.null_count else c).to_numpy(zero_copy_only=False)
            parts.setdefault(name, []).append(v)
    return {name: np.concatenate(p) for name, p in parts.items()}


def rows(payloads: list[bytes]) -> pa.Table:
    """The packed rows of one label, numbers as longs."""
    tables = []
    for payload in payloads:
        table = pa.ipc.open_stream(payload).read_all()
        kinds = [t.value_type if pa.types.is_dictionary(t) else pa.int64() if pa.types.is_integer(t) else t for t in table.schema.types]
        tables.append(table.cast(pa.schema(zip(table.column_names, kinds))))
    return pa.concat_tables(tables)


def by_block(packed: DataFrame, run: Callable[[dict, dict], dict], schema: str) -> DataFrame:
    """``run(tables, texts)`` of each block: the columns of every label, and the codes of text columns.  It returns the
    columns of ``schema``, in its order."""

    def one(table: pa.Table) -> pa.Table:
        texts: dict[str, dict] = {}
        labels, payloads = table.column("label").to_pylist(), table.column("payload").to_pylist()
        tables = {name: _unpack([p for x, p in zip(labels, payloads) if x == name], texts) for name in dict.fromkeys(labels)}
        return pa.table(run(tables, texts))

    return packed.groupBy("block").applyInArrow(one, schema)


def joint_codes(columns: Sequence[np.ndarray]) -> tuple[np.ndarray, int]:
    """One code from 0 for each combination of values, and how many there are."""
    code, n = np.zeros(len(columns[0]), np.int64), 1
    for v in columns:
        low, high = (int(v.min()), int(v.max())) if len(v) else (0, 0)
        if n * (high - low + 1) > 1 << 40:
            values, v = np.unique(v, return_inverse=True)
            low, high = 0, len(values) - 1
            if n * (high + 1) > 1 << 40:
                values, code = np.unique(code, return_inverse=True)
                n = len(values)
        code, n = code * (high - low + 1) + (v.astype(np.int64) - low), n * (high - low + 1)
    if n <= 1 << 22:
        have = np.zeros(n, bool)
        have[code] = True
        return (np.cumsum(have) - 1)[code], int(have.sum())
    values, code = np.unique(code, return_inverse=True)
    return code, len(values)


def ordered(group: np.ndarray, keys: Sequence[np.ndarray]) -> np.ndarray:
    """Row numbers by group, then by ``keys``; rows that stand in the order of the keys are only dealt to their groups."""
    if len(keys) and len(group) > 1:
        later = np.zeros(len(group) - 1, bool)
        same = np.ones(len(group) - 1, bool)
        for k in keys:
            later |= same & (k[1:] < k[:-1])
            same &= k[1:] == k[:-1]
        if later.any():
            return np.lexsort([*reversed(list(keys)), group])
    return np.argsort(group.astype(np.uint16) if len(group) and group.max() < 1 << 16 else group, kind="stable")


def starts(sorted_group: np.ndarray) -> np.ndarray:
    """First row of each group, and the number of rows."""
    return np.flatnonzero(np.append(np.append(True, sorted_group[1:] != sorted_group[:-1]), True)) if len(sorted_group) else np.zeros(1, np.int64)


def counted_before(counts: DataFrame, over: str, part: str, keys: Sequence[str], value: str = "n") -> DataFrame:
    """(part, keys..., value): totals of the earlier parts of the same ``over``, also for keys that a part lacks."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = pdf.groupby(list(keys), dropna=False, sort=False).ngroup().to_numpy()
        at, parts = pd.factorize(pdf[part], sort=True)
        grid = np.zeros((len(parts), cell.max() + 1), np.int64)
        grid[at, cell] = pdf[value]
        seen = np.cumsum(grid, 0) - grid
        p, c = np.nonzero(seen)
        _, first = np.unique(cell, return_index=True)
        out = pdf.iloc[first[c]][list(keys)].reset_index(drop=True)
        out.insert(0, part, np.asarray(parts)[p])
        return out.assign(**{value: seen[p, c]})

    fields = {f.name: f.dataType.simpleString() for f in counts.schema.fields}
    return counts.groupBy(over).applyInPandas(run, ", ".join(f"`{c}` {fields[c]}" for c in (part, *keys, value)))

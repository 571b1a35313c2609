"""k-mers that share all but one end base, matched in arrays.

An oriented k-mer is its stem, the first k - 1 bases, and one more base.  Each oriented k-mer of a table goes to the bucket of its
stem as an entry, and to the bucket of the stem it asks for as a question, both as numbers; no candidate text is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kmers import _CODE, strings, code_texts

#: fixed values: texts of a table that are placed at once, buckets, and an odd factor that mixes stems
HELD, BUCKETS, MIX = 1 << 20, 1 << 12, 0x9E3779B97F4A7C15


def text_codes(texts: pa.Array, k: int) -> np.ndarray:
    """Codes of k-mers (clean, upper case)."""
    grid = _CODE[strings(texts)[0]].reshape(-1, k)
    code = np.zeros(len(grid), np.int64)
    for i in range(k):
        code = (code << 2) | grid[:, i]
    return code


def mirrored(codes: np.ndarray, k: int) -> np.ndarray:
    """Codes of the other strand."""
    out, rest = np.zeros(len(codes), np.int64), codes.copy()
    for _ in range(k):
        out = (out << 2) | (3 - (rest & 3))
        rest >>= 2
    return out


def scattered(stem: np.ndarray) -> np.ndarray:
    """Bucket of a stem."""
    return (stem.astype(np.uint64) * np.uint64(MIX)) >> np.uint64(64 - 12)


def by_minimizer(stem: np.ndarray, k: int) -> np.ndarray:
    """Bucket of the stem's smallest few bases (8 at most) in a mixed order, so that stems that follow each other often share it."""
    n = min(8, k // 2 + 1, k - 1)
    low = np.full(len(stem), 0xFFFFFFFF, np.uint32)
    for j in range(k - n):
        low = np.minimum(low, ((stem >> (2 * j)) & ((1 << (2 * n)) - 1)).astype(np.uint32) * np.uint32(0x9E3779B1))
    return scattered(low)


def match(counts: DataFrame, k: int, follow: bool, run: Callable, schema: str, entry: Callable | None = None, ask: Callable | None = None, bucket: Callable = scattered) -> DataFrame:
    """``run(entries, n, asked, side)`` of each bucket of a table (kmer, count) of canonical k-mers, k at most 31.

    ``entries`` are the sorted codes of oriented k-mers and ``n`` their counts; ``asked`` those that ask, ``side`` 0 for the
    canonical one and 1 for its mirror image.  They ask for their last k - 1 bases with ``follow``, else for their first.
    ``entry`` and ``ask`` choose rows by count, ``bucket`` the place of a stem, 12 bits.  ``run`` returns columns of ``schema``: arrays or codes of k-mers where it has text.
    """
    m = (1 << (2 * (k - 1))) - 1
    names = [f.split()[0] for f in schema.split(", ")]
    texts = [f.split()[1] == "string" for f in schema.split(", ")]

    def place(batches):
        def placed(held):
            table = pa.Table.from_batches(held).combine_chunks()
            n = table.column(1).to_numpy()
            f = text_codes(table.column(0).chunk(0), k)
            r = mirrored(f, k)
            e = np.ones(len(n), bool) if entry is None else entry(n)
            q = np.ones(len(n), bool) if ask is None else ask(n)
            twin = e & (f != r)
            columns = {}
            codes, of = np.concatenate([f[e], r[twin]]), np.concatenate([n[e], n[twin]])
            for name, codes, beside, stem in (("entries", codes, of, codes >> 2), ("one", f[q], None, (f[q] & m) if follow else f[q] >> 2), ("two", r[q], None, (r[q] & m) if follow else r[q] >> 2)):
                at = bucket(stem).astype(np.int32)
                order = np.lexsort([codes, at])
                at, codes = at[order], codes[order]
                cuts = np.searchsorted(at, np.arange(BUCKETS + 1))
                kind = np.uint32 if 2 * k <= 32 else np.int64
                codes, beside = codes.astype(kind), None if beside is None else beside[order].astype(np.int32)
                columns[name] = [codes[a:b].tobytes() + (b"" if beside is None else beside[a:b].tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            some = [i for i in range(BUCKETS) if columns["entries"][i] or columns["one"][i] or columns["two"][i]]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *[pa.array([c[i] for i in some], pa.binary()) for c in columns.values()]], names=["bucket", *columns])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= HELD:
                yield placed(held)
                held, size = [], 0
        if size:
            yield placed(held)

    def matched(batches):
        kind = np.uint32 if 2 * k <= 32 else np.int64
        wide = np.dtype(kind).itemsize

        def one(rows):
            codes, counts, asked = [], [], ([], [])
            for e, *both in rows:
                n = len(e) // (wide + 4)
                codes.append(np.frombuffer(e, kind, n))
                counts.append(np.frombuffer(e, np.int32, n, n * wide))
                for held, b in zip(asked, both):
                    held.append(np.frombuffer(b, kind))
            codes, counts = np.concatenate(codes).astype(np.int64), np.concatenate(counts).astype(np.int64)
            order = np.argsort(codes, kind="stable")
            a, b = (np.concatenate(x).astype(np.int64) for x in asked)
            return run(codes[order], counts[order], np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]))

        def out(found):
            columns = [np.concatenate(c) for c in zip(*found)]
            for low in range(0, len(columns[0]), 1 << 16):
                part = [c[low : low + (1 << 16)] for c in columns]
                yield pa.RecordBatch.from_arrays([code_texts(c, k) if t and c.dtype == np.int64 else pa.array(c, pa.string() if t else None) for c, t in zip(part, texts)], names=names)

        at, rows, found, size = None, [], [], 0
        for batch in batches:
            for i, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if i != at and rows:
                    found.append(one(rows))
                    rows, size = [], size + len(found[-1][0])
                    if size >= 1 << 16:
                        yield from out(found)
                        found, size = [], 0
                at = i
                rows.append(row)
        if rows:
            yield from out([*found, one(rows)])

    packed = counts.select("kmer", "count").mapInArrow(place, "bucket int, entries binary, one binary, two binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(matched, schema)


def found_at(entries: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys stand among sorted entries, and whether they do."""
    at = np.minimum(np.searchsorted(entries, key), max(len(entries) - 1, 0))
    return at, entries[at] == key if len(entries) else np.zeros(len(key), bool)

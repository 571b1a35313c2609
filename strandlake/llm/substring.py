"""Repeated-passage removal over prefix-partitioned suffix trees.

A window of ``window`` words repeats when its word sequence starts anywhere else too; every word that such a
window covers is removed.  Hashes only choose places and groups; that windows are equal is decided on words.

1. Anchors.  Equal windows have their minimiser (the smallest of their ``GRAM``-word hashes) at the same
   offset, so trees need only the suffixes that start at minimisers, about one word in fourteen, and of those
   only the ones whose minimiser occurs twice anywhere.
2. Prefix groups.  Anchored suffixes travel with the words that their windows span.  They are split by their
   first words: a prefix that more than ``GROUP`` suffixes share is extended, two words at a time, until its
   groups fit in memory (``prefix_groups``).
3. Subtrees.  A group's suffixes are sorted by their words, with the lengths of common prefixes: the internal
   nodes of their tree are the runs of suffixes whose neighbours agree to a depth.  The words before the anchors
   form a second, mirrored tree.  Suffixes that share a node of depth ``window - k`` in the first tree and one of
   depth ``k`` in the second share the window that starts k words before the anchor; over all k these are the
   windows that repeat, and windows that follow each other chain into maximal repeats (``passages``).
4. Suffixes with equal first ``GRAM`` words that are still more than ``GROUP`` are taken apart into their
   single windows, which are counted by their words in memory-bounded aggregation.

Within a slice of documents equal anchors and contexts are settled on the spot and one is sent on, so a
passage that a third of all documents share costs one entry for each slice.  Null text has no words.  Rows that
repeat id and text count as two places; null ids are rows like others.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, Slice, _splitmix, blobs, materialize, range_hashes, slices, text_or_empty

WINDOW = 35
GRAM = 8
GROUP = 1 << 16
SPAN = 60  # bits of a mask
ANCHOR_BYTES = 256 << 20
_WORD_BASE = 0x2545F4914F6CDD1D


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i:i+width] for every i that has room."""
    have, size = x, 1
    while size * 2 <= width:
        have = np.minimum(have[: len(have) - size], have[size:])
        size *= 2
    room = len(x) - width + 1
    return np.minimum(have[:room], have[width - size : width - size + room])


def normalised(text: bytes) -> bytes:
    """The words joined by one space; long texts without a list of their words."""
    return b" ".join(text.split()) if len(text) < 4 << 20 else re.sub(rb"[\x20\x09-\x0d]+", b" ", text).strip(b" ")


def pack(text: bytes) -> bytes:
    return len(text).to_bytes(8, "little") + pa.compress(text, "zstd", asbytes=True)


def unpack(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


class Suffixes:
    """Windows of a slice: which starts have room, and the minimiser of each.  ``bits`` shortens the hashes (for tests)."""

    def __init__(self, piece: Slice, window: int, bits: int = 64):
        self.window = window
        starts, ends, self.first = piece.words()
        keep = np.uint64((1 << 64) - (1 << (64 - bits)))
        self.hash = piece.word_hashes(starts, ends) & keep
        self.sizes = ends - starts
        n = len(self.hash)
        self.doc = np.repeat(np.arange(piece.n), np.diff(self.first))
        self.valid = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, np.int64)
        self.gram = min(GRAM, window)
        if n < window:
            return
        at = np.arange(n - self.gram + 1)
        self.grams = range_hashes(self.hash, at, at + self.gram, _WORD_BASE) & keep
        packed = (self.grams >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
        low = _sliding_min(packed, window - self.gram + 1)
        room = len(low)
        inside = self.doc[:room] == self.doc[window - 1 : window - 1 + room]
        self.valid = np.flatnonzero(inside)
        self.anchor = (low[self.valid] & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def anchors(self) -> np.ndarray:
        """Places of all minimisers."""
        return self.anchor[_runs(self.anchor)[:-1]]

    def contexts(self, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marked anchors with the first and last start of the windows that have them as minimiser, ``SPAN`` at most."""
        change = np.append(True, self.anchor[1:] != self.anchor[:-1]) if len(self.anchor) else np.zeros(0, bool)
        begin = np.flatnonzero(change)
        nth = np.arange(len(change)) - begin[np.cumsum(change) - 1] if len(change) else begin
        first = np.flatnonzero(nth % SPAN == 0)
        last = np.append(first[1:], len(change))[: len(first)] - 1
        some = mark[self.anchor[first]]
        return self.anchor[first][some], self.valid[first][some], self.valid[last][some]

    def codes(self, anchors: np.ndarray) -> np.ndarray:
        """Prefix of an anchored suffix: 8 bits of each of its first words, as a signed 64-bit number."""
        out = np.zeros(len(anchors), np.uint64)
        for k in range(GRAM):
            out = out << np.uint64(8) | (self.hash[anchors + min(k, self.gram - 1)] >> np.uint64(56))
        return out.view(np.int64)


def _runs(values: np.ndarray) -> np.ndarray:
    """Starts of runs of equal values, and the end."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.append(np.flatnonzero(np.append(True, values[1:] != values[:-1])), len(values))


def _split(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which places hold a hash that occurs twice here, and one place for each hash."""
    order = np.argsort(hashes, kind="stable")
    cuts = _runs(hashes[order])
    many = np.zeros(len(hashes), bool)
    many[order] = np.repeat(np.diff(cuts) > 1, np.diff(cuts))
    return np.flatnonzero(many), np.sort(order[cuts[:-1]])


_ENTRY = "slice long, part int, hashes binary, keys binary, places binary"
_HITS = "slice long, keys binary, places binary"


def _entries(slice_: int, part: np.ndarray, hashes: np.ndarray, keys: np.ndarray, places: np.ndarray):
    """One row per part with a slice's entries as packed arrays, in document order."""
    order = np.argsort(part, kind="stable")
    cuts = _runs(part[order])
    return [pa.array(np.full(len(cuts) - 1, slice_)), pa.array(part[order][cuts[:-1]], pa.int32()), blobs(hashes[order], cuts), blobs(keys[order], cuts), blobs(places[order].astype(np.int32), cuts)]


def _local(slice_: int, keys: np.ndarray, places: np.ndarray):
    """Repeats that were settled within a slice: part -1."""
    cut = np.array([0, len(keys)])
    return [pa.array([slice_]), pa.array([-1], pa.int32()), pa.nulls(1, pa.binary()), blobs(keys, cut), blobs(places.astype(np.int32), cut)]


def _by_key(keys: np.ndarray, places: np.ndarray):
    """One row per key with its places."""
    order = np.argsort(keys, kind="stable")
    cuts = _runs(keys[order])
    return [pa.array(keys[order][cuts[:-1]], pa.int64()), blobs(places[order].astype(np.int32), cuts)]


_SCAN = f"id long, key long, key2 long, n_words long, sha string, {_ENTRY}"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _rows(schema: str, at: int, columns: list) -> pa.RecordBatch:
    """A batch whose columns from ``at`` on are given, and the others null."""
    names = [c.split() for c in schema.split(", ")]
    n = len(columns[0])
    arrays = [columns[k - at] if at <= k < at + len(columns) else pa.nulls(n, _KINDS[kind]) for k, (_, kind) in enumerate(names)]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in names])


def _scan(window: int, parts: int, bits: int):
    """First pass: per document its words; anchors by part; anchors that repeat here."""

    def run(batches):
        slice_ = TaskContext.get().partitionId() << 24
        for piece in slices(batches):
            s = Suffixes(piece, window, bits)
            keys = piece.column("key").astype(np.int64)
            sha = [hashlib.sha256(normalised(piece.bytes(i))).hexdigest() for i in range(piece.n)]
            yield _rows(_SCAN, 0, [piece.batch.column("id"), piece.batch.column("key"), piece.batch.column("key2"), pa.array(np.diff(s.first)), pa.array(sha)])
            if not len(s.valid):
                continue
            slice_ += 1
            at = s.anchors()
            h = s.grams[at]
            here, single = _split(h)
            doc = s.doc[at]
            place = at - s.first[doc]
            part = (_splitmix(h[single]) % np.uint64(parts)).astype(np.int32)
            yield _rows(_SCAN, 5, _entries(slice_, part, h[single], keys[doc[single]], place[single]))
            if len(here):
                yield _rows(_SCAN, 5, _local(slice_, keys[doc[here]], place[here]))

    return run


def _repeated(batches):
    """Entries of whole parts, one part after another: places of hashes that occur twice or more, by slice."""
    group, held = None, []

    def close():
        hashes, keys, places = (np.concatenate([np.frombuffer(e[k], t) for e in held]) for k, t in ((0, np.uint64), (1, np.int64), (2, np.int32)))
        of = np.repeat([e[3] for e in held], [len(e[0]) // 8 for e in held])
        many, _ = _split(hashes)
        if not len(many):
            return None
        many = many[np.argsort(of[many], kind="stable")]
        cuts = _runs(of[many])
        return pa.RecordBatch.from_arrays([pa.array(of[many][cuts[:-1]]), blobs(keys[many], cuts), blobs(places[many], cuts)], names=["slice", "keys", "places"])

    for batch in batches:
        for part, *entry in zip(*(batch.column(c).to_pylist() for c in ("part", "hashes", "keys", "places", "slice"))):
            if part != group and held:
                out = close()
                held = []
                if out is not None:
                    yield out
            group = part
            held.append(entry)
    if held:
        out = close()
        if out is not None:
            yield out


def _regroup(batches):
    """Rows of whole slices, one slice after another: one row per document with its places."""
    at, held = None, []

    def close():
        keys, places = (np.concatenate([np.frombuffer(e[k], t) for e in held]) for k, t in ((0, np.int64), (1, np.int32)))
        return pa.RecordBatch.from_arrays(_by_key(keys, places), names=["hit_key", "hit_places"])

    for batch in batches:
        for slice_, *entry in zip(*(batch.column(c).to_pylist() for c in ("slice", "keys", "places"))):
            if slice_ != at and held:
                yield close()
                held = []
            at = slice_
            held.append(entry)
    if held:
        yield close()


_FOUND = "key long, key2 long, text binary, place int, mask long, left int, span int, code long, context binary"
_HIT = "key long, key2 long, place int, mask long"


def _found(columns: dict, n: int) -> pa.RecordBatch:
    kinds = [c.split() for c in _FOUND.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[name], _KINDS[kind]) if name in columns else pa.nulls(n, _KINDS[kind]) for name, kind in kinds], names=[name for name, _ in kinds])


def _contexts(window: int, bits: int):
    """Second pass, over documents with repeated anchors: their texts, and their anchored suffixes with the words of
    all windows around.  Contexts that repeat within the slice are settled and one of them goes on."""

    def run(batches):
        for piece in slices(batches):
            s = Suffixes(piece, window, bits)
            keys, keys2 = piece.column("key").astype(np.int64), piece.column("key2").astype(np.int64)
            mark = np.zeros(len(s.hash) + 1, bool)
            for i, lists in enumerate(piece.batch.column("hits").to_pylist()):
                for b in lists:
                    at = np.frombuffer(b, np.int32)
                    mark[s.first[i] + at[at < s.first[i + 1] - s.first[i]]] = True
            anchor, low, high = s.contexts(mark)
            if not len(low):
                continue
            texts = [normalised(piece.bytes(i)) for i in range(piece.n)]
            some = np.unique(s.doc[low])
            yield _found({"key": keys[some], "key2": keys2[some], "text": [pack(texts[i]) for i in some]}, len(some))
            joined = b" ".join(t for t in texts if t)
            begin = np.concatenate([[0], np.cumsum(s.sizes + 1)])
            a, b = begin[low].tolist(), (begin[high + window] - 1).tolist()
            left, span = anchor - low, high - low + 1
            seen, same, single = {}, np.zeros(len(low), bool), []
            for k, (x, y, offset) in enumerate(zip(a, b, left.tolist())):
                other = seen.setdefault((joined[x:y], offset), k)
                if other == k:
                    single.append(k)
                else:
                    same[other] = same[k] = True
            doc = s.doc[low]
            place = low - s.first[doc]
            here = np.flatnonzero(same)
            if len(here):
                yield _found({"key": keys[doc[here]], "key2": keys2[doc[here]], "place": place[here].astype(np.int32), "mask": (np.int64(1) << span[here]) - 1}, len(here))
            one = np.array(single)
            yield _found(
                {
                    "key": keys[doc[one]], "key2": keys2[doc[one]], "place": place[one].astype(np.int32), "left": left[one].astype(np.int32), "span": span[one].astype(np.int32),
                    "code": s.codes(anchor[one]), "context": [joined[a[k] : b[k]] for k in single],
                }, len(one),
            )

    return run


def common_prefixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by their columns, and how many leading columns each shares with the one before."""
    wide = np.ascontiguousarray(rows.astype(">u4"))
    order = np.argsort(wide.view(f"S{4 * rows.shape[1]}").ravel(), kind="stable") if rows.shape[1] else np.arange(len(rows))
    differ = rows[order[1:]] != rows[order[:-1]]
    shared = np.where(differ.any(1), differ.argmax(1), rows.shape[1]) if rows.shape[1] else np.zeros(len(order) - 1, np.int64)
    return order, np.concatenate([[0], shared])


class Tree:
    """Suffix tree as its sorted leaves and the depths at which neighbours part."""

    def __init__(self, rows: np.ndarray):
        self.order, self.shared = common_prefixes(rows)

    def nodes(self, depth: int) -> np.ndarray:
        """The node at ``depth`` above each leaf."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.shared < depth) if depth else 0
        return out


def repeated_windows(contexts: pa.Array, left: np.ndarray, span: np.ndarray, window: int) -> np.ndarray:
    """Per context, bit k is set if the window k words after its start stands in another context too.

    A context is the words of ``span`` windows, one word apart, with the anchor ``left`` words from its start.
    """
    lists = pc.split_pattern(contexts.cast(pa.string()), " ")
    ids = lists.flatten().dictionary_encode().indices.to_numpy().astype(np.int64) + 1  # words, not hashes
    cuts = lists.offsets.to_numpy()
    anchor, after, before = cuts[:-1] + left, cuts[1:], cuts[:-1]
    at = anchor[:, None] + np.arange(window)
    forward = Tree(np.where(at < after[:, None], ids[np.minimum(at, len(ids) - 1)], 0))
    at = anchor[:, None] - 1 - np.arange(int(left.max(initial=0)))
    mirrored = Tree(np.where(at >= before[:, None], ids[np.maximum(at, 0)], 0))
    mask = np.zeros(len(left), np.int64)
    for offset in range(int(left.max(initial=0)) + 1):
        some = np.flatnonzero((left >= offset) & (left - offset < span))
        pair = forward.nodes(window - offset)[some] * (len(left) + 1) + mirrored.nodes(offset)[some]
        many, _ = _split(pair)
        mask[some[many]] |= np.int64(1) << (left[some[many]] - offset)
    return mask


def _subtrees(window: int):
    """Rows in order of their prefix group; whole groups are joined until ``GROUP`` suffixes are together."""

    def run(batches):
        held, size, last = [], 0, None

        def settle():
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            mask = repeated_windows(rows.column("context"), *(rows.column(c).to_numpy().astype(np.int64) for c in ("left", "span")), window)
            hit = pa.array(np.flatnonzero(mask))
            return pa.RecordBatch.from_arrays([*(rows.column(c).take(hit) for c in ("key", "key2", "place")), pa.array(mask).take(hit)], names=["key", "key2", "place", "mask"])

        for batch in batches:
            if not batch.num_rows:
                continue
            width, prefix = batch.column("width").to_numpy(), batch.column("prefix").to_numpy()
            new = np.append(True, (width[1:] != width[:-1]) | (prefix[1:] != prefix[:-1]))
            new[0] = (width[0], prefix[0]) != last
            last = (width[-1], prefix[-1])
            at = 0
            for cut in np.flatnonzero(new).tolist():
                # all before ``cut`` is whole groups
                if cut > at and size + cut - at > 0:
                    held.append(batch.slice(at, cut - at))
                    size, at = size + cut - at, cut
                if size >= GROUP:
                    yield settle()
                    held, size = [], 0
            if at < batch.num_rows:
                held.append(batch.slice(at))
                size += batch.num_rows - at
        if held:
            yield settle()

    return run


_LEVELS = (2, 4, 6, 8)


def prefix_groups(rows: DataFrame, capacity: int) -> DataFrame:
    """``rows`` with ``width`` and ``prefix``: the first words, as few as leave ``capacity`` rows at most to a group.

    Where even all ``GRAM`` words leave more, width is 0.  The prefixes that are extended number total / capacity at most
    on each level, and are broadcast.
    """
    rows = rows.withColumn("width", F.lit(_LEVELS[0]))
    open_ = rows
    for k, words in enumerate(_LEVELS):
        head = F.shiftrightunsigned("code", 8 * (GRAM - words))
        full = [r.head for r in open_.groupBy(head.alias("head")).count().filter(F.col("count") > capacity).select("head").collect()]
        if not full:
            break
        longer = _LEVELS[k + 1] if k + 1 < len(_LEVELS) else 0
        names = F.broadcast(rows.sparkSession.createDataFrame([(h, longer) for h in full], "head long, longer int"))
        rows = rows.withColumn("head", F.when(F.col("width") == words, head)).join(names, "head", "left").withColumn("width", F.coalesce("longer", "width")).drop("head", "longer")
        open_ = rows.filter(F.col("width") == longer)
    return rows.withColumn("prefix", F.when(F.col("width") > 0, F.expr(f"shiftrightunsigned(code, 8 * ({GRAM} - width))")).otherwise(F.col("code")))


def _single_windows(window: int):
    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for key, key2, place, span, context in zip(*(batch.column(c).to_pylist() for c in ("key", "key2", "place", "span", "context"))):
                words = context.split(b" ")
                for k in range(span):
                    for to, x in zip(out, (key, key2, place, 1 << k, b" ".join(words[k : k + window]))):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary())], names=["key", "key2", "place", "mask", "words"])

    return run


def _hits(found: DataFrame, window: int, parts: int, capacity: int) -> DataFrame:
    """(key, key2, hits): the repeated windows of each document as (place, mask) of their contexts."""
    grouped = prefix_groups(found.filter("context is not null").select("key", "key2", "place", "left", "span", "code", "context"), capacity)
    near = grouped.filter("width > 0").repartition(parts, "width", "prefix").sortWithinPartitions("width", "prefix").mapInArrow(_subtrees(window), _HIT)
    single = grouped.filter("width = 0").select("key", "key2", "place", "span", "context").mapInArrow(_single_windows(window), f"{_HIT}, words binary")
    # equal contexts of one slice were folded, so a window that occurs twice is in two rows
    often = single.groupBy("words").agg(F.count("*").alias("n")).filter("n > 1").select("words")
    far = single.join(often, "words", "left_semi").select("key", "key2", "place", "mask")
    every = near.union(far).union(found.filter("mask is not null").select("key", "key2", "place", "mask"))
    return every.groupBy("key", "key2", "place").agg(F.bit_or("mask").alias("mask")).groupBy("key", "key2").agg(F.collect_list(F.struct("place", "mask")).alias("hits"))


def passages(hits, window: int) -> list[tuple[int, int]]:
    """Maximal repeats of a document, as (first word, words): runs of repeated windows that start one word apart."""
    starts = sorted(h["place"] + k for h in hits for k in range(h["mask"].bit_length()) if h["mask"] >> k & 1)
    out = []
    for s in starts:
        if out and s == out[-1][0] + out[-1][1] - window + 1:
            out[-1][1] += 1
        else:
            out.append([s, window])
    return [(a, n) for a, n in out]


_PASSAGES = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))
_CUT = "key long, key2 long, removed long, cut_sha string, cut_text string, repeats array<struct<start:long,words:long>>"


def _cut(window: int, texts: bool):
    """Remove the covered words of documents whose repeated windows are known."""

    def run(batches):
        for batch in batches:
            out, size = [], 0
            for i, (key, key2, packed, hits) in enumerate(zip(*(batch.column(c) for c in ("key", "key2", "text", "hits")))):
                text = unpack(packed.as_py()) + b" "
                data = np.frombuffer(text, np.uint8)
                ends = np.flatnonzero(data == 32)
                change = np.zeros(len(ends) + 1, np.int64)
                found = passages(hits.as_py(), window)
                for start, n in found:
                    change[start] += 1
                    change[start + n] -= 1
                covered = np.cumsum(change[:-1]) > 0
                kept = data[np.repeat(~covered, np.diff(ends, prepend=-1))].tobytes()[:-1]
                out.append((key.as_py(), key2.as_py(), int(covered.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None, [{"start": a, "words": n} for a, n in found] if texts else None))
                size += len(kept)
                if size > SLICE_BYTES or i + 1 == batch.num_rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), _PASSAGES))]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "key2", "removed", "cut_sha", "cut_text", "repeats"])
                    out, size = [], 0

    return run


def _leaves(table: DataFrame, n: int) -> DataFrame:
    """(hit_key, hits): places of each document whose hash stands in the table twice or more."""
    rows = table.filter("part is not null")
    found = rows.filter("part >= 0").select("slice", "part", "hashes", "keys", "places").repartition(n, "part").sortWithinPartitions("part").mapInArrow(_repeated, _HITS)
    every = found.union(rows.filter("part < 0").select("slice", "keys", "places"))
    by_document = every.repartition(n, "slice").sortWithinPartitions("slice").mapInArrow(_regroup, "hit_key long, hit_places binary")
    return by_document.groupBy("hit_key").agg(F.collect_list("hit_places").alias("hits"))  # one item, more where rows repeat


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False, capacity: int = GROUP, bits: int = 64) -> DataFrame:
    """``id_col``, n_words, n_removed, kept_sha256 for each row; ``with_text`` adds kept_text and repeats, the document's
    maximal repeats as (start, words), both null where nothing goes.

    ``capacity``: suffixes of a prefix group.  ``bits`` shortens all hashes of words; the result does not depend on it.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("key"), F.xxhash64(F.lit(1), text, F.col(id_col)).alias("key2"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # an anchor in about 14 words of 6 bytes takes 20 bytes
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    lots = max(parts * 4, size // 4 // ANCHOR_BYTES)
    scan = materialize(rows.mapInArrow(_scan(window, lots, bits), _SCAN), "anchors")

    hits = _leaves(scan, max(parts, lots // 4))
    joined = rows.join(hits.hint("shuffle_hash"), rows["key"] == hits["hit_key"]).select("key", "key2", "text", "hits")
    found = materialize(joined.mapInArrow(_contexts(window, bits), _FOUND), "suffixes")
    repeats = _hits(found, window, max(parts, found.filter("context is not null").count() // capacity), capacity)
    texts = found.filter("text is not null").select("key", "key2", "text").join(repeats, ["key", "key2"])
    cut = texts.mapInArrow(_cut(window, with_text), _CUT).dropDuplicates(["key", "key2"])
    out = scan.filter("key is not null").select("id", "key", "key2", "n_words", "sha").join(cut, ["key", "key2"], "left")
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("removed", F.lit(0)).alias("n_removed"), F.coalesce("cut_sha", "sha").alias("kept_sha256"),
        *([F.col("cut_text").alias("kept_text"), "repeats"] if with_text else []),
    )

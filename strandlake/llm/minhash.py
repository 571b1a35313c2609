"""Near-duplicate detection by bottom-k sketches of one hash function.

1. A document's set of distinct word shingles gives its size, a 128-bit fingerprint and its ``SKETCH``
   smallest hashes.  Documents with equal sets become one node.
2. Inverted lists of retained values generate candidates.  A pair at similarity 0.8 shares at least
   ``LEAST_LISTED`` of the 32 smallest values of its union but for a chance of about 2e-9; so each node is
   listed under its ``LISTED - LEAST_LISTED + 1`` rarest of these only, and values that very many
   documents share drop out.  The estimate has ``SKETCH`` values, of 32 bits, and asks for ``LEAST_SHARED``, at
   about the same chance.  Sets smaller than the sketch are listed and compared exactly.
3. Lists are not expanded into pairs.  First every member meets the list's most central member;
   union-sketch estimates filter these pairs and exact Jaccard on full sets verifies them.
4. Lists whose members are then still in different components are read in blocks of bounded size;
   members that share enough sketch values with one of another component go to tiles of at most
   ``TILE`` documents a side, where exact intersections of all full sets are one matrix product.
   A tile gives a spanning forest of its links.  Full sets are made again from whole texts.

Null and empty texts have empty sets and link with nothing.  Rows are known by the hash of id and text, so rows that
repeat an id count one by one.  A null id takes part in links; it is named by no component that has another id, and a
component of null ids only has a null component_id.  Equal sets are one class.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Slice, _splitmix, blobs, free_name, materialize, slices, text_or_empty
from .components import connected_components

LISTED, LEAST_LISTED = 32, 10
SKETCH, LEAST_SHARED = 64, 28
BLOCK = 1024
TILE = 256
FAN = 256


def shingle_sets(piece: Slice, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each document."""
    starts, ends, first = piece.words()
    h = piece.word_hashes(starts, ends, lower=True)
    lengths = np.diff(first)
    room = len(h) - width + 1
    grams = np.zeros(0, np.uint64)
    if room > 0:
        grams = np.zeros(room, np.uint64)
        odd = _splitmix(np.arange(101, 101 + width, dtype=np.uint64)) | np.uint64(1)
        for k in range(width):
            grams += h[k : k + room] * odd[k]
        grams = _splitmix(grams)
    out = []
    for i, n in enumerate(lengths.tolist()):
        at = first[i]
        if n >= width:
            out.append(np.unique(grams[at : at + n - width + 1].view(np.int64)))
        elif n:
            # a whole short document: another constant by length keeps it apart from shingles
            mixed = np.zeros(1, np.uint64)
            for k in range(n):
                mixed = _splitmix(mixed + h[at + k : at + k + 1] + np.uint64(n))
            out.append(mixed.view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    u = s.view(np.uint64)
    return tuple(int(x) for x in np.array([u.sum(dtype=np.uint64), _splitmix(u ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)], np.uint64).view(np.int64))


def _profile(width: int):
    def run(batches):
        for piece in slices(batches):
            sets = shingle_sets(piece, width)
            prints = [_fingerprint(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.batch.column("id"), piece.batch.column("key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([p[0] for p in prints], pa.int64()),
                    pa.array([p[1] for p in prints], pa.int64()), pa.array([s[:LISTED] for s in sets], pa.list_(pa.int64())),
                    pa.array([(s[:SKETCH] >> 32).astype(np.int32) for s in sets], pa.list_(pa.int32())),
                ],
                names=["id", "key", "n", "f1", "f2", "listed", "sketch"],
            )

    return run


def _verify(width: int, percent: int):
    """Rows in order of (hub, part, role): the hub's text, then the texts of members that meet it."""

    def run(batches):
        hub, own = None, None
        for piece in slices(batches):
            sets = shingle_sets(piece, width)
            a, b = [], []
            columns = [piece.batch.column(c).to_pylist() for c in ("hub", "part", "role", "nid", "f1", "f2")]
            for s, h, part, role, nid, f1, f2 in zip(sets, *columns):
                if _fingerprint(s) != (f1, f2):  # another row with the same key
                    continue
                if role == 0:
                    hub, own = (h, part), s
                elif hub == (h, part):
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(s) - both):
                        a.append(h)
                        b.append(nid)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _groups(batches, keys: list[str], columns: list[str]):
    """Runs of rows with equal keys, as lists by column; input in order of the keys."""
    at, held = None, [[] for _ in columns]
    for batch in batches:
        have = batch.num_rows
        lists = [batch.column(c).to_pylist() for c in (*keys, *columns)]
        for row in range(have):
            key = tuple(x[row] for x in lists[: len(keys)])
            if key != at:
                if at is not None:
                    yield at, held
                at, held = key, [[] for _ in columns]
            for to, x in zip(held, lists[len(keys) :]):
                to.append(x[row])
    if at is not None:
        yield at, held


def _incidence(sets: list[np.ndarray], sides: np.ndarray):
    """Row and column of every element, of columns that both sides hold."""
    sizes = np.array([len(x) for x in sets])
    rows = np.repeat(np.arange(len(sets)), sizes)
    values, columns = np.unique(np.concatenate(sets), return_inverse=True)
    left = np.bincount(columns[(sides[rows] & 1) > 0], minlength=len(values))
    right = np.bincount(columns[(sides[rows] & 2) > 0], minlength=len(values))
    some = np.bincount(columns, minlength=len(values))
    both = (left > 0) & (right > 0) & (some > 1)
    order = np.cumsum(both) - 1
    keep = both[columns]
    return rows[keep], order[columns[keep]], int(both.sum())


def intersections(sets: list[np.ndarray], sides: np.ndarray, wide: int = 4096) -> np.ndarray:
    """Sizes of all intersections; sides 1 and 2 need not meet themselves, 3 is in both."""
    out = np.zeros((len(sets), len(sets)), np.float32)
    rows, columns, n = _incidence(sets, sides)
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    for k in range(0, n, wide):
        part = slice(*np.searchsorted(columns, [k, k + wide]))
        m = np.zeros((len(sets), min(wide, n - k)), np.float32)
        m[rows[part], columns[part] - k] = 1
        out += m @ m.T
    return out


def _meet(batches):
    """Blocks of one list: which members share enough sketch values with one of another component."""
    for (_, i, j), (lot, nid, label, bucket, sketch) in _groups(batches, ["value", "i", "j"], ["lot", "nid", "label", "bucket", "sketch"]):
        lot, label = np.array(lot), np.array(label)
        sides = (lot == i) * 1 + (lot == j) * 2
        sets = [np.unique(np.array(x, np.int64)) for x in sketch]
        sizes = np.array([len(x) for x in sets])
        least = np.minimum(LEAST_SHARED, np.ceil(0.8 * sizes)).astype(np.float32)
        least = np.maximum(least[:, None], least[None, :])
        ok = (intersections(sets, sides) >= least) & (label[:, None] != label[None, :]) & ((sides[:, None] & 1) > 0) & ((sides[None, :] & 2) > 0)
        x, y = np.nonzero(ok)
        nid = np.array(nid, np.int64)
        names, bucket = np.unique(np.array(bucket, np.int64), return_inverse=True)
        low, high, m = np.minimum(bucket[x], bucket[y]), np.maximum(bucket[x], bucket[y]), len(sets)
        code = np.unique(np.concatenate([(low * m + high) * m + x, (low * m + high) * m + y]))
        tile = code // m
        cuts = np.append(np.flatnonzero(np.append(True, tile[1:] != tile[:-1])), len(tile)) if len(tile) else np.zeros(1, np.int64)
        ta, tb = names[tile[cuts[:-1]] // m], names[tile[cuts[:-1]] % m]
        if len(ta):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ta, tb)), pa.array(np.maximum(ta, tb)), blobs(nid[code % m], cuts)], names=["ta", "tb", "nids"])


def _members(batches):
    """Tiles with their documents, each once; input in order of tiles."""
    for (ta, tb), (nids,) in _groups(batches, ["ta", "tb"], ["nids"]):
        nid = np.unique(np.concatenate([np.frombuffer(b, np.int64) for b in nids]))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nid), ta)), pa.array(np.full(len(nid), tb)), pa.array(nid)], names=["ta", "tb", "nid"])


def spanning_links(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    fresh, out = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not fresh[root]:
            continue
        fresh[root] = False
        stack = [root]
        while stack:
            at = stack.pop()
            near = np.flatnonzero(linked[at] & fresh)
            fresh[near] = False
            out += [(at, k) for k in near.tolist()]
            stack += near.tolist()
    return out


def _tiles(width: int, percent: int):
    """Texts in order of their tile: exact links among all of a tile's documents."""

    def sets_of(batches):
        for piece in slices(batches):
            sets = shingle_sets(piece, width)
            same = [_fingerprint(s) == f for s, f in zip(sets, zip(piece.batch.column("f1").to_pylist(), piece.batch.column("f2").to_pylist()))]
            where = [k for k, ok in enumerate(same) if ok]
            yield piece.batch.select(["ta", "tb", "nid"]), [sets[k] for k in where], where

    def run(batches):
        at, nids, held = None, [], []

        def settle():
            if len(held) < 2:
                return None
            sizes = np.array([len(x) for x in held])
            both = intersections(held, np.full(len(held), 3))
            linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
            np.fill_diagonal(linked, False)
            edges = spanning_links(linked)
            if not edges:
                return None
            return pa.RecordBatch.from_arrays([pa.array([nids[a] for a, _ in edges], pa.int64()), pa.array([nids[b] for _, b in edges], pa.int64())], names=["a", "b"])

        for rows, sets, where in sets_of(batches):
            ta, tb, nid = (rows.column(k).to_pylist() for k in range(3))
            for s, k in zip(sets, where):
                if (ta[k], tb[k]) != at:
                    done = settle()
                    if done is not None:
                        yield done
                    at, nids, held = (ta[k], tb[k]), [], []
                if nid[k] not in nids[-1:]:
                    nids.append(nid[k])
                    held.append(s)
        done = settle()
        if done is not None:
            yield done

    return run


class NearDuplicates:
    """Nodes (distinct shingle sets) of a table and the components of their links."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80):
        self.width, self.percent = width, percent
        text = text_or_empty(text_col)
        self.texts = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("key"), text.alias("text"))
        self.rows = materialize(self.texts.mapInArrow(_profile(width), "id long, key long, n long, f1 long, f2 long, listed array<long>, sketch array<int>"), "profiles")
        nodes = self.rows.filter("n > 0").groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.min("key").alias("key"), F.first("n").alias("n"), F.first("listed").alias("listed"), F.first("sketch").alias("sketch"))
        self.nodes = materialize(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")

    def lists(self) -> DataFrame:
        """(value, nid, score): nodes under their rarest shared values; score tells central members."""
        values = self.nodes.select("nid", "n", F.size("listed").alias("k"), F.explode("listed").alias("value"))
        shared = values.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
        own = Window.partitionBy("nid")
        # sets of up to 25 shingles: they and their partners are in their sketches whole
        quota = F.when(F.col("n") <= 25, F.col("k") - F.ceil(F.col("n") * 0.8) + 1).otherwise(F.col("k") - LEAST_LISTED + 1)
        listed = (
            values.join(shared, "value")
            .withColumn("rank", F.row_number().over(own.orderBy("df", "value")) + F.col("k") - F.count("*").over(own))
            .withColumn("score", F.sum("df").over(own)).filter(F.col("rank") <= quota).select("value", "nid", "score")
        )
        return materialize(listed, "lists")

    def _likely(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and union sketch allow the similarity."""
        a = self.nodes.select(F.col("nid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        b = self.nodes.select(F.col("nid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
        both = F.size(F.array_intersect(F.array_intersect("sa", "sb"), F.col("u")))
        return (
            pairs.join(a, "a").join(b, "b").filter(100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb"))
            .withColumn("u", union).filter(both >= F.least(F.lit(LEAST_SHARED), F.ceil(F.size("u") * 0.8))).select("a", "b")
        )

    def _links(self, pairs: DataFrame) -> DataFrame:
        """The pairs that exact similarity confirms.  A hub's members are dealt to parts of ``FAN``."""
        pairs = materialize(self._likely(pairs), "pairs")
        size = pairs.groupBy("a").agg(F.count("*").alias("c"))
        dealt = pairs.join(size, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / FAN)).cast("int"))
        roles = dealt.select(F.col("a").alias("hub"), "part", F.lit(0).alias("role"), F.col("a").alias("nid")).distinct().union(dealt.select("a", "part", F.lit(1), "b"))
        named = roles.join(self.nodes.select("nid", "key", "f1", "f2"), "nid")
        full = named.join(self.texts.select("key", "text"), "key").select("hub", "part", "role", "nid", "f1", "f2", "text")
        n = int(self.texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ordered = full.repartition(n, "hub", "part").sortWithinPartitions("hub", "part", "role")
        return materialize(ordered.mapInArrow(_verify(self.width, self.percent), "a long, b long"), "links")

    def _stars(self, lists: DataFrame) -> DataFrame:
        """Each list's members against its most central member."""
        top = lists.groupBy("value").agg(F.max(F.struct("score", "nid")).alias("top"), F.count("*").alias("m")).filter("m > 1")
        met = lists.join(top.select("value", F.col("top.nid").alias("a")), "value").filter("nid != a")
        return met.select("a", F.col("nid").alias("b")).distinct()

    def _rest(self, lists: DataFrame) -> DataFrame:
        """Links between members of a list that are still in different components."""
        open_ = lists.groupBy("value").agg(F.count("*").alias("m"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("value", "m")
        open_ = materialize(lists.join(open_, "value"), "open")
        home = open_.groupBy("nid").agg(F.max(F.struct("m", "value")).alias("home"))
        bucket = F.xxhash64("home.value", F.pmod(F.xxhash64("nid"), F.ceil(F.col("home.m") / TILE)))
        known = home.select("nid", bucket.alias("bucket")).join(self.nodes.select("nid", "sketch"), "nid")
        lots = F.ceil(F.col("m") / BLOCK)
        rows = (
            open_.withColumn("lot", F.pmod(F.xxhash64(F.lit(3), "nid"), lots)).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), lots - 1)))
            .select("value", F.least("lot", "with").alias("i"), F.greatest("lot", "with").alias("j"), "lot", "nid", "label").join(known, "nid")
        )
        n = int(self.texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        met = rows.repartition(n, "value", "i", "j").sortWithinPartitions("value", "i", "j").mapInArrow(_meet, "ta long, tb long, nids binary")
        met = met.repartition(n, "ta", "tb").sortWithinPartitions("ta", "tb").mapInArrow(_members, "ta long, tb long, nid long")
        full = met.join(self.nodes.select("nid", "key", "f1", "f2"), "nid").join(self.texts.select("key", "text"), "key").select("ta", "tb", "nid", "f1", "f2", "text")
        tiled = full.repartition(n, "ta", "tb").sortWithinPartitions("ta", "tb", "nid")
        return materialize(tiled.mapInArrow(_tiles(self.width, self.percent), "a long, b long"), "links")

    def components(self) -> DataFrame:
        """(node, label) of the nodes that have links."""
        lists = self.lists()
        links = self._links(self._stars(lists))
        labels = connected_components(links).withColumnRenamed("node", "nid")
        marked = materialize(lists.join(labels, "nid", "left").withColumn("label", F.coalesce("label", "nid")), "marked")
        return connected_components(links.union(self._rest(marked)))


def row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), text_or_empty(text_col))


def _labelled(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(id, key, n, label, component_id) of each row; without words label is null."""
    work = NearDuplicates(docs, id_col, text_col, width, percent)
    labels = work.components().withColumnRenamed("node", "nid")
    nodes = materialize(work.nodes.select("nid", "f1", "f2", "rep").join(labels, "nid", "left").withColumn("label", F.coalesce("label", "nid")), "named")
    lowest = nodes.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = nodes.join(lowest, "label").select("f1", "f2", "label", "component_id")
    found = work.rows.filter("n > 0").select("id", "key", "n", "f1", "f2").join(named, ["f1", "f2"]).select("id", "key", "n", "label", "component_id")
    alone = work.rows.filter("n = 0").select("id", "key", "n", F.lit(None).cast("long").alias("label"), F.col("id").alias("component_id"))
    return found.union(alone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``id_col``, n_shingles, component_id, kept for each row."""
    rows = _labelled(docs, id_col, text_col, width, percent)
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id (a null id is the largest), and all rows without words."""
    kept_key, key, nth = (free_name(docs, n) for n in ("__kept_key", "__key", "__nth"))
    rows = _labelled(docs, id_col, text_col, width, percent).filter("n > 0")
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"))
    kept = first.select(F.col("first.key").alias(kept_key))
    words = text_or_empty(text_col).rlike(r"[^\x20\x09-\x0D]")
    marked = docs.filter(words).withColumn(key, row_key(id_col, text_col))
    same = Window.partitionBy(key).orderBy(F.lit(0))
    one = marked.join(kept, marked[key] == kept[kept_key], "left_semi").withColumn(nth, F.row_number().over(same)).filter(F.col(nth) == 1)
    return one.select(docs.columns).union(docs.filter(~words))

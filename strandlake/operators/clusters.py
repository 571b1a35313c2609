"""Similarity graphs: shared minimisers, components, and pairs of near reads."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, keep
from .kmers import minimizer_postings


def usable_postings(reads: DataFrame, k: int = 21, w: int = 11, most: int = 50) -> DataFrame:
    """Postings of minimisers that 2 to ``most`` reads hold; repetitive ones go before any self-join."""
    posts = keep(minimizer_postings(reads, k, w), "postings")
    usable = posts.groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n").between(2, most)).select("hash")
    return posts.join(usable, "hash", "left_semi")


def shared_edges(postings: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, shared) with a < b: reads that share ``least`` minimisers or more.  A list has a bounded length."""
    a, b = postings.select("hash", F.col("read_idx").alias("a")), postings.select("hash", F.col("read_idx").alias("b"))
    return a.join(b, "hash").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)


def hubs(postings: DataFrame) -> DataFrame:
    """(read_idx, hubs): the first reads of the lists of two or more that a read stands in, itself included where it is the first.

    Linear in the postings, so no list is too long; a read is linked with its hubs only, so all but the hubs leave the graph at once.
    """
    w = Window.partitionBy("hash").orderBy("read_idx")
    # in the order of the list the smallest so far is its first read
    rows = postings.select("read_idx", F.min("read_idx").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("a"), F.lead("read_idx").over(w).alias("after"))
    return rows.filter("a < read_idx or after is not null").groupBy("read_idx").agg(F.collect_set("a").alias("hubs"))


#: fixed value: edges that one task may join at the end
LAST_EDGES = 1 << 20


def _mixed(v, seed: int):
    """A permutation of all longs, another one for each seed: two Feistel rounds over halves of 32 bits."""
    low = F.lit((1 << 32) - 1)
    left, right = F.shiftrightunsigned(v, 32), v.bitwiseAND(low)
    left = left.bitwiseXOR(F.xxhash64(right, F.lit(2 * seed)).bitwiseAND(low))
    right = right.bitwiseXOR(F.xxhash64(left, F.lit(2 * seed + 1)).bitwiseAND(low))
    return F.shiftleft(left, 32).bitwiseOR(right)


def _unmixed(h, seed: int):
    low = F.lit((1 << 32) - 1)
    left, right = F.shiftrightunsigned(h, 32), h.bitwiseAND(low)
    right = right.bitwiseXOR(F.xxhash64(left, F.lit(2 * seed + 1)).bitwiseAND(low))
    left = left.bitwiseXOR(F.xxhash64(right, F.lit(2 * seed)).bitwiseAND(low))
    return F.shiftleft(left, 32).bitwiseOR(right)


def _joined(edges: DataFrame) -> DataFrame:
    """(node, root) of few edges, in one task."""

    def run(batches):
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        ends = np.concatenate([np.concatenate(x) for x in zip(*held)])
        nodes, at = np.unique(ends, return_inverse=True)
        a, b = at[: len(at) // 2], at[len(at) // 2 :]
        root = np.arange(len(nodes))
        while True:
            x, y = root[a], root[b]
            if (x == y).all():
                break
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])

    return edges.coalesce(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame) -> DataFrame:
    """(read_idx, label): smallest read of each component, by randomised contraction.

    Each round every node joins the first of its neighbours and itself in an order drawn anew, which leaves two thirds of the
    nodes or fewer, as expected; edges between different ones go on.  So all rounds together are as large as a few of the first.
    """
    now, rounds = keep(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), "edges"), []
    while True:
        seed = len(rounds)
        both = now.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(now.select(F.col("b").alias("node"), F.col("a").alias("to")))
        first = both.groupBy("node").agg(F.min(_mixed(F.col("to"), seed)).alias("to"))
        chosen = keep(first.select("node", _unmixed(F.least("to", _mixed(F.col("node"), seed)), seed).alias("root")), "chosen")
        rounds.append(chosen)
        # the planner takes what is left after a filter for small
        left = now.join(chosen.select(F.col("node").alias("a"), F.col("root").alias("x")).hint("merge"), "a").join(chosen.select(F.col("node").alias("b"), F.col("root").alias("y")).hint("merge"), "b")
        before, now = now, keep(left.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(before)
        if now.count() <= LAST_EDGES:
            rounds.append(keep(_joined(now), "chosen"))
            break
    found = rounds[-1]
    for chosen in reversed(rounds[:-1]):
        found = chosen.join(found.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    found = keep(found, "roots")
    low = found.groupBy("root").agg(F.min("node").alias("label"))
    return found.join(low, "root").select(F.col("node").alias("read_idx"), "label")


def clusters(reads: DataFrame, strategy: str = "selective", k: int = 21, w: int = 11, most: int = 50) -> DataFrame:
    """(read_idx, label) for every read: ``selective`` needs two shared minimisers, ``all`` one."""
    if strategy == "selective":
        edges = shared_edges(usable_postings(reads, k, w, most))
    elif strategy == "all":
        # a component's smallest read is the first of its lists, so labels of hubs are labels of all
        held = keep(hubs(minimizer_postings(reads, k, w)).select("read_idx", F.array_min("hubs").alias("hub"), "hubs"), "hubs")
        edges = held.select(F.col("hub").alias("a"), F.explode("hubs").alias("b")).filter("a <> b").distinct()
        of_hubs = components(edges).withColumnRenamed("read_idx", "hub")
        found = held.select("read_idx", "hub").join(of_hubs.hint("merge"), "hub", "left").select("read_idx", F.coalesce("label", "hub").alias("label"))
        return reads.select("read_idx").join(found.hint("merge"), "read_idx", "left").withColumn("label", F.coalesce("label", "read_idx"))
    else:
        raise ValueError(f"cluster strategy {strategy!r}")
    return reads.select("read_idx").join(components(edges), "read_idx", "left").withColumn("label", F.coalesce("label", "read_idx"))

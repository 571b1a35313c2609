"""Entropy, mutual information and adaptive code lengths over long-form base tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.reads import bases
from . import blocks


def entropy(rows: DataFrame, symbol: str) -> DataFrame:
    """One row: n and h, in bits.  Counts are reduced before the shuffle; totals come from the counts."""
    counts = rows.groupBy(symbol).agg(F.count("*").alias("n"))
    total, weighted = F.sum("n"), F.sum(F.col("n") * F.log2("n"))
    return counts.agg(F.coalesce(total, F.lit(0)).alias("n"), F.coalesce(F.log2(total) - weighted / total, F.lit(0.0)).alias("h"))


def conditional_entropy(rows: DataFrame, context: Sequence[str], symbol: str) -> DataFrame:
    """One row: n, h of the symbol, h_given of the symbol in its context, gain (their difference)."""
    cells = rows.groupBy(*context, symbol).agg(F.count("*").alias("n"))
    by_context = cells.groupBy(*context).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log2("n")).alias("w"))
    given = by_context.agg(F.sum("n").alias("n"), ((F.sum(F.col("n") * F.log2("n")) - F.sum("w")) / F.sum("n")).alias("h_given"))
    alone = cells.groupBy(symbol).agg(F.sum("n").alias("n")).agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("h"))
    return given.crossJoin(alone).select("n", "h", "h_given", (F.col("h") - F.col("h_given")).alias("gain"))  # one row each


def context_gains(rows: DataFrame, contexts: dict[str, Sequence[str]], symbol: str) -> DataFrame:
    """``conditional_entropy`` for several contexts in one pass: one scan, one grouping-set aggregate.

    Result: context, n, h, h_given, gain_pct, saved_bytes.
    """
    columns = sorted({c for cs in contexts.values() for c in cs})
    sets = [(), *[tuple(cs) for cs in contexts.values()]]
    cells = rows.groupingSets([[F.col(c) for c in (*cs, symbol)] for cs in sets], *[F.col(c) for c in (*columns, symbol)]).agg(F.grouping_id(*[F.col(c) for c in (*columns, symbol)]).alias("gid"), F.count("*").alias("n"))

    def gid(cs):
        return sum(1 << (len(columns) - i) for i, c in enumerate(columns) if c not in cs)

    by_context = cells.groupBy("gid", *columns).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("w"))
    given = by_context.groupBy("gid").agg(F.sum("t").alias("n"), ((F.sum(F.col("t") * F.log2("t")) - F.sum("w")) / F.sum("t")).alias("h_given"))
    name = F.lit(None).cast("string")
    for label, cs in contexts.items():
        name = F.when(F.col("gid") == gid(cs), label).otherwise(name)
    whole = given.filter(F.col("gid") == gid(())).select(F.col("h_given").alias("h"))
    return (
        given.filter(F.col("gid") != gid(())).crossJoin(F.broadcast(whole))  # one row
        .select(name.alias("context"), "n", "h", "h_given", (100 * (F.col("h") - F.col("h_given")) / F.col("h")).alias("gain_pct"), ((F.col("h") - F.col("h_given")) * F.col("n") / 8).alias("saved_bytes"))
    )


def log_gamma(x: Column) -> Column:
    """Natural logarithm of the gamma function for x > 0, by Stirling's series moved up by 8: good to 1e-10."""
    up = x + 8.0
    low = F.log(x)
    for k in range(1, 8):
        low = low + F.log(x + float(k))
    series = 1 / (12 * up) - 1 / (360 * F.pow(up, 3)) + 1 / (1260 * F.pow(up, 5)) - 1 / (1680 * F.pow(up, 7))
    return (up - 0.5) * F.log(up) - up + 0.5 * math.log(2 * math.pi) + series - low


def rising_bits(start, n: Column, step: int = 1) -> Column:
    """log2 of start * (start + step) * ... of ``n`` factors."""
    first = start / F.lit(float(step)) if isinstance(start, Column) else F.lit(start / step)
    return F.when(n > 0, n * math.log2(step) + (log_gamma(first + n) - log_gamma(first)) / math.log(2)).otherwise(0.0)


def adaptive_cost(rows: DataFrame, context: Sequence[str], symbol: str, symbols: int, prior: int = 1, step: int = 1) -> DataFrame:
    """One row: n, bits, bits_per_symbol of an adaptive model whose counts start at ``prior`` and grow by ``step``.

    A symbol costs -log2 of the share that it had in its context before it was counted.  Over a context these shares
    multiply to a quotient of rising products, whatever the order, so counts by context and symbol are enough.
    """
    cells = rows.groupBy(*context, symbol).agg(F.count("*").alias("n"))
    by_context = cells.groupBy(*context).agg(F.sum("n").alias("n"), F.sum(rising_bits(prior, F.col("n"), step)).alias("gained"))
    bits = F.sum(rising_bits(prior * symbols, F.col("n"), step) - F.col("gained"))
    return by_context.agg(F.sum("n").alias("n"), bits.alias("bits"), (bits / F.sum("n")).alias("bits_per_symbol"))


def adaptive_cost_by_block(rows: DataFrame, context: Sequence[str], symbol: str, symbols: int, every: int, prior: int = 1, step: int = 1) -> DataFrame:
    """(block, n, bits) of the same model for each ``every`` reads, its counts carried from block to block.  Windows run
    over blocks, not rows."""
    cells = rows.groupBy(F.floor(F.col("read_idx") / every).alias("block"), *context, symbol).agg(F.count("*").alias("n"))
    before = lambda *keys: Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum("n").over(before(*context, symbol)), F.lit(0))
    gained = cells.withColumn("gained", rising_bits(F.lit(float(prior)) + step * seen, F.col("n"), step))
    totals = gained.groupBy("block", *context).agg(F.sum("n").alias("n"), F.sum("gained").alias("gained"))
    seen = F.coalesce(F.sum("n").over(before(*context)), F.lit(0))
    spent = totals.withColumn("bits", rising_bits(F.lit(float(prior * symbols)) + step * seen, F.col("n"), step) - F.col("gained"))
    return spent.groupBy("block").agg(F.sum("n").alias("n"), F.sum("bits").alias("bits"))


def halved_bits(codes: np.ndarray, cuts: np.ndarray, symbols: int, limit: int, prior: int = 1, step: int = 1, round_up: bool = False) -> float:
    """Cost of the symbols of many contexts, each in order between two ``cuts``.  A context's counts are halved as soon
    as their total reaches ``limit``: rounded up, or down but to 1 at least.  Between two halvings the order does not
    count, so all contexts go on by one halving at a time."""
    have = int(codes.max(initial=-1)) + 1
    if have > symbols:
        raise ValueError("more symbols than the model has")
    at, ends, bits = cuts[:-1].copy(), cuts[1:], 0.0
    # a last column stands for the symbols that do not occur
    weights = np.append(np.ones(have, np.int64), symbols - have)
    counts, total = np.full((len(at), have + 1), prior, np.int64), np.full(len(at), prior * symbols)

    def rising(first, n):
        return np.log2(np.repeat(first, n) + step * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))).sum()

    live = np.flatnonzero(at < ends)
    while len(live):
        n = np.minimum(np.maximum(1, -(-(limit - total[live]) // step)), ends[live] - at[live])
        rows = np.arange(n.sum()) + np.repeat(at[live] - (np.cumsum(n) - n), n)
        part = np.bincount(np.repeat(np.arange(len(live)) * (have + 1), n) + codes[rows], minlength=len(live) * (have + 1))
        now = counts[live]
        some = np.flatnonzero(part)
        bits += rising(total[live], n) - rising(now.ravel()[some], part[some])
        now += step * part.reshape(now.shape)
        sums = now @ weights
        over = sums >= limit
        now[over] = (now[over] + 1) // 2 if round_up else np.maximum(now[over] >> 1, 1)
        sums[over] = now[over] @ weights
        counts[live], total[live] = now, sums
        at[live] += n
        live = live[at[live] < ends[live]]
    return float(bits)


def halving_cost(rows: DataFrame, context: Sequence[str], symbol: str, symbols: int, limit: int, block: int, prior: int = 1, step: int = 1, round_up: bool = False, order: Sequence[str] = ("read_idx", "pos")) -> DataFrame:
    """One row: n, bits, bits_per_symbol of the adaptive model that halves its counts at ``limit``.

    A model starts anew with each ``block`` of reads; blocks are coded in parallel, all contexts of one at once.
    """
    names = [f"__c{i}" for i in range(len(context))]
    columns = [F.col(c).alias(n) for c, n in [*zip(context, names), *((c, f"__o{i}") for i, c in enumerate(order)), (symbol, "__symbol")]]

    def run(tables, texts):
        r = tables["rows"]
        n = len(r["__symbol"])
        group = blocks.joint_codes([r[c] for c in names])[0] if names else np.zeros(n, np.int64)
        by = blocks.ordered(group, [r[f"__o{i}"] for i in range(len(order))])
        group = group[by]
        codes = np.unique(r["__symbol"], return_inverse=True)[1][by]
        cuts = blocks.starts(group)
        width = max(1, (1 << 22) // (int(codes.max(initial=0)) + 2))
        bits = sum(halved_bits(codes[cuts[low] : cuts[min(low + width, len(cuts) - 1)]], cuts[low : low + width + 1] - cuts[low], symbols, limit, prior, step, round_up) for low in range(0, len(cuts) - 1, width))
        return {"n": [n], "bits": [float(bits)]}

    costs = blocks.by_block(blocks.pack(rows, F.floor(F.col("read_idx") / block), columns), run, "n long, bits double")
    bits = F.coalesce(F.sum("bits"), F.lit(0.0))
    return costs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), bits.alias("bits"), (bits / F.sum("n")).alias("bits_per_symbol"))


def convergence(blocks: DataFrame) -> DataFrame:
    """Cumulative and own bits a base of each block of (block, n, bits)."""
    running = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)  # over block totals
    return blocks.select(F.col("block").alias("window"), "n", (F.col("bits") / F.col("n")).alias("window_bits"), (F.sum("bits").over(running) / F.sum("n").over(running)).alias("total_bits"))


def occupancy(rows: DataFrame, context: Sequence[str], thresholds: Sequence[int]) -> DataFrame:
    """Contexts and rows at or above each threshold."""
    counts = rows.groupBy(*context).agg(F.count("*").alias("n"))
    at = counts.select("n", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")).filter(F.col("n") >= F.col("threshold"))
    return at.groupBy("threshold").agg(F.count("*").alias("contexts"), F.sum("n").alias("observations"))


def upper_median(values: Column) -> Column:
    """Element n div 2 (from 0) of the sorted values."""
    s = F.array_sort(values)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def occupancy_median(rows: DataFrame, context: Sequence[str]) -> DataFrame:
    """Upper median of observations per context, from the histogram of counts."""
    sizes = rows.groupBy(*context).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("c"))
    run = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return sizes.withColumn("upto", F.sum("c").over(run)).withColumn("all", F.sum("c").over(Window.partitionBy(F.lit(0)))).filter("upto > floor(all / 2)").agg(F.min("n").alias("median"))


def position_profile(bases: DataFrame) -> DataFrame:
    """Per position: n, mean, population deviation and entropy of the score."""
    cells = bases.groupBy("pos", "phred").agg(F.count("*").alias("n"))
    n, s, s2 = F.sum("n"), F.sum(F.col("n") * F.col("phred")), F.sum(F.col("n") * F.col("phred") * F.col("phred"))
    return cells.groupBy("pos").agg(n.alias("n"), (s / n).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), s2 / n - (s / n) * (s / n))).alias("std"), (F.log2(n) - F.sum(F.col("n") * F.log2("n")) / n).alias("h"))


def noise_entropy(bases: DataFrame, textbook: bool = False) -> DataFrame:
    """Per position: mean error probability p and substitution entropy.  The textbook form adds
    p * log2(3); the other subtracts it, as published logs have it."""
    p = F.col("p")
    flip = -(p * F.log2(p) + (1 - p) * F.log2(1 - p))
    return bases.groupBy("pos").agg(F.avg(F.pow(F.lit(10.0), -F.col("phred") / 10.0)).alias("p")).select("pos", "p", (flip + (1 if textbook else -1) * p * F.log2(F.lit(3.0))).alias("h"))


def quality_ngrams(reads: DataFrame, width: int = 5) -> DataFrame:
    """Counts of score triples by position and cluster of mean quality (ASCII mean div width)."""
    from ..functions.quality import mean_quality

    cluster = F.floor(mean_quality("quality") / width).cast("int")
    rows = bases(reads.select(F.struct("read_idx", cluster.alias("cluster")).alias("read_idx"), "sequence", "quality"), following=2)
    return rows.groupBy(F.col("read_idx.cluster").alias("cluster"), "pos", "phred", "next1", "next2").agg(F.count("*").alias("n"))


def length_histogram(reads: DataFrame, most: int = 511) -> DataFrame:
    """Reads by length, dense from 0 to ``most``."""
    have = reads.groupBy(F.length("sequence").alias("length")).agg(F.count("*").alias("n"))
    return reads.sparkSession.range(most + 1).select(F.col("id").cast("int").alias("length")).join(have, "length", "left").select("length", F.coalesce("n", F.lit(0)).alias("n"))


def position_variance_explained(bases: DataFrame) -> DataFrame:
    """1 - variance around position means / variance, from counts by position and score."""
    cells = bases.groupBy("pos", "phred").agg(F.count("*").alias("n"))
    by_pos = cells.groupBy("pos").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("phred")).alias("s"), F.sum(F.col("n") * F.col("phred") * F.col("phred")).alias("s2"))
    n, s, s2 = F.sum("n"), F.sum("s"), F.sum("s2")
    return by_pos.agg((1 - (s2 / n - F.sum(F.col("s") * F.col("s") / F.col("n")) / n) / (s2 / n - (s / n) * (s / n))).alias("explained"))

"""Paired reads, window dictionaries, rolling consensus chains and lossy quality codebooks."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S

FAR = 32767


def mates(first: DataFrame, second: DataFrame) -> DataFrame:
    """(read_idx, mate_idx, ...) of two files read together: mate i of file 2 has index i + n."""
    n = first.count()
    a = first.select("read_idx", F.col("sequence").alias("sequence_1"), F.col("id").alias("id_1"))
    b = second.select("read_idx", (F.col("read_idx") + n).alias("mate_idx"), F.col("sequence").alias("sequence_2"), F.col("id").alias("id_2"))
    return a.join(b, "read_idx")


def pair_order(permutation: DataFrame, n: int) -> DataFrame:
    """New order of pairs: file 1 by new_pos, each mate ``n`` places after its partner.

    ``permutation`` has (new_pos, read_idx) of all 2n reads, file 2 from index n.
    """
    by_lane = F.floor(F.col("new_pos") / 65536)
    one = permutation.filter(F.col("read_idx") < n).select("read_idx", "new_pos", by_lane.alias("lane"))
    first = one.groupBy("lane").agg(F.count("*").alias("c")).select("lane", (F.sum("c").over(Window.orderBy("lane")) - F.col("c")).alias("base"))  # one row for 65,536 reads
    ranked = one.join(first, "lane").select("read_idx", (F.col("base") + F.row_number().over(Window.partitionBy("lane").orderBy("new_pos")) - 1).alias("rank"))
    return ranked.select("read_idx", F.col("rank").alias("place")).unionByName(ranked.select((F.col("read_idx") + n).alias("read_idx"), (F.col("rank") + n).alias("place")))


def pair_flags(pairs: DataFrame) -> DataFrame:
    """Class of each pair of mappings (position_1, is_rc_1, position_2, is_rc_2): 0 both placed, opposite and
    within 32767, 1 both placed otherwise, 2 only the first, 3 only the second, 4 none."""
    p1, p2 = F.col("position_1").isNotNull(), F.col("position_2").isNotNull()
    near = (F.abs(F.col("position_2") - F.col("position_1")) < FAR) & (F.col("is_rc_1") != F.col("is_rc_2"))
    return pairs.withColumn("flag", F.when(p1 & p2 & near, 0).when(p1 & p2, 1).when(p1, 2).when(p2, 3).otherwise(4))


def mate_position(position, distance):
    """Place of a mate from its partner's and a signed distance."""
    return position + distance


def window_dictionaries(reads: DataFrame, width: int = 32) -> DataFrame:
    """(side, window, reads): reads by the substring either side of their middle."""
    mid = F.floor(F.length("sequence") / 2).cast("int")
    sides = F.explode(F.array(F.struct(F.lit("left").alias("side"), F.substring("sequence", mid - width + 1, F.lit(width)).alias("window")), F.struct(F.lit("right").alias("side"), F.substring("sequence", mid + 1, F.lit(width)).alias("window")))).alias("x")
    return reads.filter(F.length("sequence") >= 2 * width).select("read_idx", sides).groupBy("x.side", "x.window").agg(F.count("*").alias("reads"), F.min("read_idx").alias("first"))


def _window_hashes(texts: list[str], width: int, first: int, n: int) -> np.ndarray:
    """Hashes of ``n`` windows from ``first`` on of texts of one length, a row each, as wrapping polynomials."""
    with np.errstate(over="ignore"):
        letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).reshape(len(texts), -1)[:, first : first + n + width - 1].astype(np.uint64)
        out = np.zeros((len(texts), n), np.uint64)
        for k in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + letters[:, k : k + n] + np.uint64(1)
        return out ^ (out >> np.uint64(29))


#: fixed values: bits of the filter of windows at most, and probes of it
FILTER_BITS, FILTER_PROBES = 1 << 29, 4


def _filter_places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        step = (hashes * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(31)) | np.uint64(1)
        return [(hashes + np.uint64(k) * step) % np.uint64(bits) for k in range(FILTER_PROBES)]


def match_candidates(reads: DataFrame, width: int = 20, most: int = 4) -> DataFrame:
    """(a, b, is_rc, shift, distance): b's centre window stands in a, or in a's reverse complement where ``is_rc``,
    ``shift`` bases right of a's own centre, for shifts below half of a; where they overlap they differ at ``most`` places.

    All reads of a window are met.  Unshifted pairs stand once.  A filter of all centre windows, of bounded size, drops
    the places of a that are no read's window before anything is shuffled; those that it lets through meet by text.
    """
    middle = lambda c: F.floor(F.length(c) / 2).cast("int")
    rows = reads.select("read_idx", F.upper("sequence").alias("s")).filter(F.length("s") >= 2 * width)
    listed = rows.select(F.col("read_idx").alias("b"), F.col("s").alias("sb"), F.substring("s", middle("s") - width + 1, F.lit(width)).alias("window"))
    both = rows.withColumn("is_rc", F.lit(False)).unionByName(rows.select("read_idx", S.reverse_complement("s").alias("s"), F.lit(True).alias("is_rc")))
    bits = 64
    while bits < min(16 * rows.count(), FILTER_BITS):
        bits *= 2
    slices = max(1, bits >> 23)  # of the filter, 1 MB each; a word is sent by its slice

    def words(batches):
        for pdf in batches:
            hashes = np.concatenate([_window_hashes(g.tolist(), width, n // 2 - width, 1)[:, 0] for n, g in pdf["s"].groupby(pdf["s"].str.len())] or [np.zeros(0, np.uint64)])
            places = np.unique(np.concatenate(_filter_places(hashes, bits)))
            word, at = places // np.uint64(64), places % np.uint64(64)
            cuts = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
            yield pd.DataFrame({"word": word[cuts].astype(np.int64), "value": (np.bitwise_or.reduceat(np.uint64(1) << at, cuts) if len(cuts) else word).astype(np.int64)})

    def sliced(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": [int(pdf["slice"].iloc[0])], "word": [pdf["word"].to_numpy().astype("<i8").tobytes()], "value": [pdf["value"].to_numpy().astype("<i8").tobytes()]})

    filled = rows.select("s").mapInPandas(words, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).withColumn("slice", (F.col("word") % slices).cast("int"))
    table = np.zeros(bits // 64, np.int64)
    for r in filled.groupBy("slice").applyInPandas(sliced, "slice int, word binary, value binary").collect():
        table[np.frombuffer(r.word, "<i8")] = np.frombuffer(r.value, "<i8")
    sent = reads.sparkSession.sparkContext.broadcast(table.view(np.uint64))  # FILTER_BITS at most

    def probe(batches):
        for batch in batches:
            texts, length = np.array(batch.column("s").to_pylist(), object), pc.utf8_length(batch.column("s")).to_numpy(zero_copy_only=False)
            for n in np.unique(length).tolist():
                at, half = np.flatnonzero(length == n), n // 2
                hashes = _window_hashes(texts[at].tolist(), width, half - width, half)
                may = np.ones(hashes.shape, bool)
                for place in _filter_places(hashes, bits):
                    may &= (sent.value[place // np.uint64(64)] >> (place % np.uint64(64))) & np.uint64(1) == 1
                row, shift = np.nonzero(may)
                found = batch.take(pa.array(at[row]))
                windows = [s[half - width + k : half + k] for s, k in zip(texts[at[row]].tolist(), shift.tolist())]
                yield pa.RecordBatch.from_arrays([*found.columns, pa.array(shift, pa.int32()), pa.array(windows, pa.string())], names=["a", "sa", "is_rc", "shift", "window"])

    probes = both.select("read_idx", "s", "is_rc").mapInArrow(probe, "a long, sa string, is_rc boolean, shift int, window string")
    met = probes.join(listed, "window").filter((F.col("a") != F.col("b")) & ((F.col("shift") > 0) | (F.col("a") < F.col("b"))))
    # a and b are laid with their centres ``shift`` apart
    start = middle("sa") - middle("sb") + F.col("shift")
    low_a, low_b = F.greatest(start, F.lit(0)), F.greatest(-start, F.lit(0))
    n = F.least(F.length("sa") - low_a, F.length("sb") - low_b)
    far = S.hamming_within(F.substring("sa", low_a + 1, n), F.substring("sb", low_b + 1, n), most)
    return met.withColumn("distance", far).filter("distance is not null").select("a", "b", "is_rc", "shift", "distance")


def rolling_consensus(reads: DataFrame, chains: DataFrame) -> DataFrame:
    """(read_idx, consensus, distance): for reads of a chain (chain, rank, read_idx), all aligned at their start, the
    majority of the reads so far; ties go to the first in the order A, C, T, G.  Chains go by as a stream; what is kept
    from read to read is one chain's counts."""
    #: fixed values: order of ties
    letters = np.frombuffer(b"ACTG", np.uint8)
    number = np.full(256, 4, np.uint8)
    number[letters] = np.arange(4)

    def run(batches):
        chain, counts = None, np.zeros((0, 4), np.int64)
        for batch in batches:
            chains_, texts = batch.column("chain").to_pylist(), batch.column("sequence").to_pylist()
            out, low = [], 0
            while low < len(texts):
                # slices bound the counts of all their reads
                longest, high = 0, low
                while high < len(texts) and (high == low or max(longest, len(texts[high])) * (high + 1 - low) <= 1 << 19):
                    longest = max(longest, len(texts[high]))
                    high += 1
                n = high - low
                grid = np.full((n, longest), 4, np.uint8)
                raw = np.full((n, longest), 0, np.uint8)
                for i, t in enumerate(texts[low:high]):
                    raw[i, : len(t)] = np.frombuffer(t.encode("ascii", "replace"), np.uint8)
                grid = number[raw]
                own = (grid[:, :, None] == np.arange(4, dtype=np.uint8)).astype(np.int64)
                upto = np.cumsum(own, 0)
                new = np.array([i == 0 or c != chains_[low + i - 1] for i, c in enumerate(chains_[low:high])])
                first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
                upto -= (upto - own)[first]
                if chains_[low] == chain:
                    until = int(np.flatnonzero(new)[1]) if new.sum() > 1 else n
                    both = min(longest, len(counts))
                    upto[:until, :both] += counts[:both]
                else:
                    counts = np.zeros((0, 4), np.int64)
                top = letters[upto.argmax(2)]
                far = top != raw
                for i, t in enumerate(texts[low:high]):
                    out.append((top[i, : len(t)].tobytes().decode(), int(far[i, : len(t)].sum())))
                kept = counts[longest:] if new.sum() == 1 and chains_[low] == chain else counts[:0]
                chain, counts = chains_[high - 1], np.concatenate([upto[-1], kept])
                low = high
            yield pa.RecordBatch.from_arrays([batch.column("read_idx"), pa.array([c for c, _ in out], pa.string()), pa.array([d for _, d in out], pa.int64())], names=["read_idx", "consensus", "distance"])

    rows = chains.select("chain", "rank", "read_idx").join(reads.select("read_idx", "sequence"), "read_idx")
    return rows.repartition("chain").sortWithinPartitions("chain", "rank").select("chain", "read_idx", "sequence").mapInArrow(run, "read_idx long, consensus string, distance long")


def quality_transitions(rows: DataFrame) -> DataFrame:
    """(pos, before, phred, n): scores given the one before, by position; from bases with their context."""
    return rows.groupBy("pos", F.col("q1").alias("before"), "phred").agg(F.count("*").alias("n"))


def _quantizer(p: np.ndarray, states: int) -> tuple[np.ndarray, float]:
    """Least-squares quantizer of a distribution over scores: value of each score, and its distortion."""
    q = np.arange(len(p))
    w, wq, wq2 = (np.concatenate([[0], np.cumsum(p * x)]) for x in (np.ones(len(p)), q, q**2))

    def cost(i, j):
        m = w[j] - w[i]
        return np.where(m > 0, wq2[j] - wq2[i] - (wq[j] - wq[i]) ** 2 / np.where(m > 0, m, 1), 0)

    best = cost(0, q + 1)
    costs = cost(q, q[:, None] + 1)  # of the scores from a column's number to a row's
    cuts = []
    for _ in range(1, states):
        table = np.where((q > 0) & (q <= q[:, None]), best[q - 1] + costs, np.inf)
        cuts.append(table.argmin(1))
        best = np.minimum(best, table.min(1))
    out, j = np.zeros(len(p), np.int64), len(p)
    for c in [*reversed(cuts), None]:
        i = int(c[j - 1]) if c is not None and j > 0 else 0
        m = w[j] - w[i]
        out[i:j] = round((wq[j] - wq[i]) / m) if m > 0 else (i + j) // 2
        j = i
    return out, float((p * (q - out) ** 2).sum())


def quality_codebook(transitions: DataFrame, bits: float, top: int = 41) -> pd.DataFrame:
    """(pos, before, low, high, ratio, low_values, high_values): for each column and previous output the quantizers with
    consecutive numbers of states around the entropy target, how often to take the larger one, and what either makes of
    each score.  The table of transitions has at most positions x scores x scores rows, so it is handled on the driver."""
    rows = transitions.toPandas()
    out = []
    for (pos, before), g in rows.groupby(["pos", "before"]):
        p = np.bincount(np.minimum(g["phred"], top), g["n"], top + 1) / g["n"].sum()
        most = max(1, int((p > 0).sum()))

        def quantized(states, p=p):
            v, _ = _quantizer(p, states)
            m = np.bincount(v, p)
            m = m[m > 0]
            return float(-(m * np.log2(m)).sum()), v.tolist()

        states, (low, low_values) = 1, quantized(1)
        while states < most and (found := quantized(states + 1))[0] <= bits:
            states, (low, low_values) = states + 1, found
        high, high_values = quantized(min(states + 1, most))
        ratio = 0.0 if high <= low else min(1.0, max(0.0, (bits - low) / (high - low)))
        out.append((pos, before, states, min(states + 1, most), ratio, low_values, high_values))
    return pd.DataFrame(out, columns=["pos", "before", "low", "high", "ratio", "low_values", "high_values"])


def quantize_reads(reads: DataFrame, book: pd.DataFrame, seed: int = 1) -> DataFrame:
    """(read_idx, quality): scores by the codebook, column by column, given the output before.

    Which of the two quantizers a score takes is drawn from the read's index and the position, so reruns agree.  A column
    or previous output that the book lacks takes the nearest one that it has; without any the score stays.
    """
    table = {}
    for r in book.itertuples():
        table.setdefault(int(r.pos), []).append((int(r.before), float(r.ratio), np.array(r.low_values), np.array(r.high_values)))
    columns = {}
    for pos, entries in table.items():
        entries.sort(key=lambda e: e[0])
        size = max(len(v) for e in entries for v in e[2:])
        whole = lambda v, size=size: np.append(v, np.full(size - len(v), v[-1]))
        columns[pos] = (np.array([e[0] for e in entries]), np.array([e[1] for e in entries]), np.stack([whole(e[2]) for e in entries]), np.stack([whole(e[3]) for e in entries]))
    sent = reads.sparkSession.sparkContext.broadcast(columns)  # positions x scores quantizers

    def quantized(index, texts):
        """Outputs of texts of any lengths: column by column, all reads at once."""
        columns = sent.value
        last = max(columns, default=0)
        sizes = np.array([len(t) for t in texts])
        width = int(sizes.max(initial=0))
        draw, score = np.zeros((len(texts), width)), np.zeros((len(texts), width), np.int64)
        for i, (key, t) in enumerate(zip(index, texts)):
            draw[i, : len(t)] = np.random.default_rng([seed, key]).random(len(t))
            score[i, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64) - 33
        before = np.zeros(len(texts), np.int64)
        for pos in range(width):
            if (entry := columns.get(min(pos, last))) is not None:
                known, ratio, low, high = entry
                right = np.minimum(np.searchsorted(known, before), len(known) - 1)
                left = np.maximum(right - 1, 0)
                at = np.where(before - known[left] <= np.abs(known[right] - before), left, right)  # of equally near ones the lower
                s = np.minimum(score[:, pos], low.shape[1] - 1)
                score[:, pos] = np.where(draw[:, pos] < ratio[at], high[at, s], low[at, s])
            before = score[:, pos]
        return [r[:n].tobytes().decode("utf-32-le") for r, n in zip((score + 33).astype(np.uint32), sizes)]

    def run(batches):
        for batch in batches:
            index, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[str | None] = [None] * len(texts)
            low = 0
            while low < len(texts):  # as many reads as fit in a matrix of 4M scores
                high, longest = low, 0
                while high < len(texts) and (high == low or max(longest, len(texts[high] or "")) * (high + 1 - low) <= 1 << 22):
                    longest = max(longest, len(texts[high] or ""))
                    high += 1
                some = [i for i in range(low, high) if texts[i] is not None]
                for i, t in zip(some, quantized([index[i] for i in some], [texts[i] for i in some])):
                    out[i] = t
                low = high
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["read_idx", "quality"])

    return reads.select("read_idx", "quality").mapInArrow(run, "read_idx long, quality string")


def preprocess(reads: DataFrame, block: int = 256_000, longest: int = 511) -> DataFrame:
    """Reads with their block and whether they hold N; longer reads raise."""
    checked = F.when(F.length("sequence") <= longest, F.col("sequence")).otherwise(F.raise_error(F.lit(f"read longer than {longest} bases")).cast("string"))
    return reads.select("read_idx", F.floor(F.col("read_idx") / block).alias("block"), checked.alias("sequence"), F.contains("sequence", F.lit("N")).alias("has_n"))


def noise_positions(mismatches):
    """Distances between mismatch positions; 65535 and more are cut into steps."""
    pos = F.transform(mismatches, lambda m: m["pos"])
    return F.transform(pos, lambda p, i: F.when(i == 0, p).otherwise(p - F.get(pos, i - 1)))


def singleton_alignment(singletons: DataFrame, contigs: DataFrame, k: int = 15, most: int = 24) -> DataFrame:
    """Reads left alone, placed on the contigs of others within ``most`` differences."""
    from .kmers import map_reads

    return map_reads(singletons, contigs, k, most).filter("contig_id is not null")


def mapped_pairs(mappings: DataFrame, n: int) -> DataFrame:
    """(read_idx, position_1, is_rc_1, position_2, is_rc_2) of mappings of 2n reads, file 2 from index n."""
    one = mappings.filter(F.col("read_idx") < n).select("read_idx", F.col("contig_id").alias("contig_1"), F.col("position").alias("position_1"), F.col("is_rc").alias("is_rc_1"))
    two = mappings.filter(F.col("read_idx") >= n).select((F.col("read_idx") - n).alias("read_idx"), F.col("contig_id").alias("contig_2"), F.col("position").alias("position_2"), F.col("is_rc").alias("is_rc_2"))
    return one.join(two, "read_idx")


def decode_reads(contigs: DataFrame, reads: DataFrame, noise: DataFrame) -> DataFrame:
    """(read_idx, sequence) from contigs that lie one after another: ``reads`` has the absolute position, length and
    strand, ``noise`` (read_idx, pos, base) the bases that differ on the read's strand."""
    size = F.length("sequence").cast("long")
    placed = contigs.withColumn("lane", F.floor(F.col("contig_id") / 65536))
    lanes = placed.groupBy("lane").agg(F.sum(size).alias("bases")).select("lane", (F.sum("bases").over(Window.orderBy("lane")) - F.col("bases")).alias("lane_start"))  # one row for 65,536 contigs
    starts = placed.join(F.broadcast(lanes), "lane").select("contig_id", F.col("sequence").alias("contig"), (F.col("lane_start") + F.sum(size).over(Window.partitionBy("lane").orderBy("contig_id")) - size).alias("start"))
    found = reads.join(starts, "contig_id")
    region = F.substring("contig", (F.col("position") - F.col("start") + 1).cast("int"), F.col("length"))
    strand = F.when(F.col("is_rc"), S.reverse_complement(region)).otherwise(region)
    patches = noise.groupBy("read_idx").agg(F.map_from_entries(F.collect_list(F.struct("pos", "base"))).alias("patch"))
    rows = found.select("read_idx", strand.alias("own")).join(patches, "read_idx", "left")
    fixed = S.let(F.struct("own", "patch"), lambda x: F.array_join(F.transform(F.sequence(F.lit(0), F.length(x["own"]) - 1), lambda i: F.coalesce(F.try_element_at(x["patch"], i), F.substring(x["own"], i + 1, F.lit(1)))), ""))
    return rows.select("read_idx", F.when(F.col("patch").isNull(), F.col("own")).otherwise(fixed).alias("sequence"))


def absolute_positions(contigs: DataFrame, mappings: DataFrame) -> DataFrame:
    """Mappings with the position counted over all contigs, one after another."""
    before = contigs.select(F.col("contig_id").alias("other"), F.length("sequence").cast("long").alias("size"))
    lane = F.floor(F.col("other") / 65536)
    run = before.withColumn("lane", lane)
    lanes = run.groupBy("lane").agg(F.sum("size").alias("bases")).select("lane", (F.sum("bases").over(Window.orderBy("lane")) - F.col("bases")).alias("lane_start"))
    starts = run.join(F.broadcast(lanes), "lane").select(F.col("other").alias("contig_id"), (F.col("lane_start") + F.sum("size").over(Window.partitionBy("lane").orderBy("other")) - F.col("size")).alias("start"))
    return mappings.join(starts, "contig_id").withColumn("position", F.col("start") + F.col("position")).drop("start")

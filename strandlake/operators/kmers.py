"""k-mer tables: counting, trimming, neighbours, prediction tables, indexes and read mapping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S

#: fixed values: total bases below which k applies
K_BY_BASES = [(5_000_000, 15), (50_000_000, 19), (500_000_000, 23), (2_000_000_000, 27)]
MOST_COUNT = 65535
#: fixed values: k-mers that a counter holds, bases that are coded at once, and bits of a bucket
HELD, SPAN, BUCKET_BITS = 1 << 21, 1 << 21, 12
#: fixed value: odd, so that multiplying modulo a power of two can be undone
MIX = 0x9E3779B97F4A7C15


def choose_k(reads: DataFrame) -> DataFrame:
    """One row: bases and k."""
    k = F.lit(31)
    for most, value in reversed(K_BY_BASES):
        k = F.when(F.col("bases") < most, value).otherwise(k)
    return reads.agg(F.coalesce(F.sum(F.length("sequence")), F.lit(0)).alias("bases")).withColumn("k", k)


def explode_kmers(reads: DataFrame, k: int, step: int = 1) -> DataFrame:
    """(read_idx, pos, kmer) without k-mers that hold other letters."""
    return reads.select("read_idx", F.explode(S.kmers("sequence", k, step)).alias("x")).select("read_idx", "x.pos", "x.kmer").filter(~F.col("kmer").rlike("[^ACGTacgt]"))


def canonical_kmers(reads: DataFrame, k: int, step: int = 1) -> DataFrame:
    """(read_idx, pos, kmer, is_forward): the smaller strand's k-mer; letter order is hash order, so any k works."""
    if k <= 31:
        return _coded_kmers(reads, k, step)
    rc = S.reverse_complement("kmer")
    rows = explode_kmers(reads.withColumn("sequence", F.upper("sequence")), k, step)
    return rows.select("read_idx", "pos", F.least("kmer", rc).alias("kmer"), (F.col("kmer") <= rc).alias("is_forward"))


_CODE = np.full(256, 255, np.uint8)
for _i, _b in enumerate(S.BASES):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _i


def strings(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after another, and where each starts, with the end; null is empty."""
    array = array.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8)
    data = array.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


def canonical_codes(sequences: pa.Array, k: int) -> Iterator[np.ndarray]:
    """2 bits a base (first base highest) of the canonical k-mers without other letters, up to ``SPAN`` bases at once."""
    for forward, back, _ in _both_codes(sequences, k):
        yield np.minimum(forward, back)


def _both_codes(sequences: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Codes of the k-mers without other letters on both strands, and where they start among all bases."""
    raw, offsets = strings(sequences)
    room = np.repeat(offsets[1:], np.diff(offsets)) if len(raw) else np.zeros(0, np.int64)
    for low in range(0, len(raw) - k + 1, SPAN):
        code = _CODE[raw[low : low + SPAN + k - 1]]
        n = len(code) - k + 1
        bad = np.concatenate([[0], np.cumsum(code > 3, dtype=np.int32)])
        good = (bad[k:] == bad[:-k]) & (room[low : low + n] - np.arange(low, low + n) >= k)
        # windows of doubling width are put together to one of k
        f, r = code.astype(np.int64) & 3, 3 - (code.astype(np.int64) & 3)
        width, have, forward, back = 1, 0, None, None
        while True:
            if k & width:
                if forward is None:
                    forward, back = f, r
                else:
                    m = len(f) - have
                    forward, back = (forward[:m] << (2 * width)) | f[have:], (r[have:] << (2 * have)) | back[:m]
                have += width
            if 2 * width > k:
                break
            m = len(f) - width
            f, r = (f[:m] << (2 * width)) | f[width:], (r[width:] << (2 * width)) | r[:m]
            width *= 2
        yield forward[:n][good], back[:n][good], low + np.flatnonzero(good)


def code_texts(codes: np.ndarray, k: int) -> pa.Array:
    """The k-mers of codes."""
    letters = np.frombuffer(S.BASES.encode(), np.uint8)
    grid = np.empty((len(codes), k), np.uint8)
    for i in range(k):
        grid[:, i] = letters[(codes >> (2 * (k - 1 - i))) & 3]
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer((np.arange(len(codes) + 1) * k).astype(np.int32)), pa.py_buffer(grid))


def _count_codes(reads: DataFrame, k: int) -> DataFrame:
    """Counting in arrays: k-mers are coded and counted where they are read, ``HELD`` at a time, and travel as sorted runs by
    bucket of their mixed code, so that a task holds one bucket of one run a reader."""
    bits = 2 * k
    own = min(BUCKET_BITS, bits)
    mask, mix, back = np.uint64((1 << bits) - 1), np.uint64(MIX), np.uint64(pow(MIX, -1, 1 << 64))
    kind = np.uint32 if bits <= 32 else np.uint64

    def runs(batches):
        def flush(held):
            mixed, n = np.unique((np.concatenate(held).astype(np.uint64) * mix) & mask, return_counts=True)
            bucket = (mixed >> np.uint64(bits - own)).astype(np.int32)
            cuts = np.flatnonzero(np.append(np.append(True, bucket[1:] != bucket[:-1]), True))
            mixed, n = mixed.astype(kind), np.minimum(n, MOST_COUNT).astype(np.uint16)
            payloads = [mixed[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]]), pa.array(payloads, pa.binary())], names=["bucket", "payload"])

        held, size = [], 0
        for batch in batches:
            for codes in canonical_codes(batch.column(0), k):
                held.append(codes)
                size += len(codes)
                if size >= HELD:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    def totals(batches):
        def total(payloads):
            codes, counts = [], []
            for p in payloads:
                n = len(p) // (kind().itemsize + 2)
                codes.append(np.frombuffer(p, kind, n))
                counts.append(np.frombuffer(p, np.uint16, n, n * kind().itemsize))
            mixed, at = np.unique(np.concatenate(codes), return_inverse=True)
            n = np.bincount(at, np.concatenate(counts), len(mixed)).astype(np.int64)
            return ((mixed.astype(np.uint64) * back) & mask).astype(np.int64), np.minimum(n, MOST_COUNT)

        def texts(found):
            codes, counts = (np.concatenate(x) for x in zip(*found))
            for low in range(0, len(codes), 1 << 16):
                yield pa.RecordBatch.from_arrays([code_texts(codes[low : low + (1 << 16)], k), pa.array(counts[low : low + (1 << 16)])], names=["kmer", "count"])

        at, own_payloads, found = None, [], []
        for batch in batches:
            for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if bucket != at and own_payloads:
                    found.append(total(own_payloads))
                    own_payloads = []
                    if sum(len(c) for c, _ in found) >= 1 << 16:
                        yield from texts(found)
                        found = []
                at = bucket
                own_payloads.append(payload)
        if own_payloads:
            yield from texts([*found, total(own_payloads)])

    packed = reads.select("sequence").mapInArrow(runs, "bucket int, payload binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(totals, "kmer string, count long")


def _coded_kmers(reads: DataFrame, k: int, step: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            idx = batch.column(0)
            raw, offsets = strings(batch.column(1))
            odd = len(raw) and raw.max() > 127
            for forward, back, at in _both_codes(batch.column(1), k):
                row = np.searchsorted(offsets, at, side="right") - 1
                pos = at - offsets[row]
                if odd:  # characters, not bytes
                    chars = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
                    pos = chars[at] - chars[offsets[row]]
                some = pos % step == 0
                row, pos, forward, back = row[some], pos[some], forward[some], back[some]
                for low in range(0, len(row), 1 << 16):
                    p = slice(low, low + (1 << 16))
                    yield pa.RecordBatch.from_arrays([idx.take(pa.array(row[p])), pa.array(pos[p].astype(np.int32)), code_texts(np.minimum(forward[p], back[p]), k), pa.array(forward[p] <= back[p])], names=["read_idx", "pos", "kmer", "is_forward"])

    return reads.select(F.col("read_idx").cast("long").alias("read_idx"), "sequence").mapInArrow(run, "read_idx long, pos int, kmer string, is_forward boolean")


def count_kmers(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, count) of canonical k-mers, saturating."""
    if k <= 31:
        return _count_codes(reads, k)
    return canonical_kmers(reads, k).groupBy("kmer").agg(F.least(F.count("*"), F.lit(MOST_COUNT)).alias("count"))


def trim_threshold(counts: DataFrame) -> DataFrame:
    """One row: 0 where more than 90 % of the k-mers occur once, else 1."""
    return counts.agg(F.when(F.sum(F.when(F.col("count") == 1, 1).otherwise(0)) > 0.9 * F.count("*"), 0).otherwise(1).alias("threshold"))


def trim(counts: DataFrame) -> DataFrame:
    """k-mers above the threshold."""
    return counts.crossJoin(F.broadcast(trim_threshold(counts))).filter(F.col("count") > F.col("threshold")).drop("threshold")  # one row


def neighbours(counts: DataFrame, k: int | None = None) -> DataFrame:
    """(kmer, side, base, next, count): the k-mers of the set one base to the right or left, in canonical form.  With ``k``, the
    length of all of them, up to 31, they are matched as numbers."""
    if k and k <= 31:
        return _coded_neighbours(counts, k)
    n = F.length("kmer")
    base = F.explode(F.array(*[F.lit(b) for b in S.BASES])).alias("base")
    right = counts.select("kmer", F.lit("right").alias("side"), base).withColumn("raw", F.concat(F.substring("kmer", F.lit(2), n - 1), "base"))
    left = counts.select("kmer", F.lit("left").alias("side"), base).withColumn("raw", F.concat("base", F.substring("kmer", F.lit(1), n - 1)))
    both = right.unionByName(left).select("kmer", "side", "base", F.least("raw", S.reverse_complement("raw")).alias("next"))
    # the planner takes exploded tables for small ones
    return both.join(counts.select(F.col("kmer").alias("next"), "count").hint("merge"), "next").select("kmer", "side", "base", "next", "count")


def _coded_neighbours(counts: DataFrame, k: int) -> DataFrame:
    from .stems import found_at, match, mirrored

    m = (1 << (2 * (k - 1))) - 1

    def run(entries, n, asked, side):
        own = np.where(side == 0, asked, mirrored(asked, k))
        parts = []
        for b in range(4):
            key = ((asked & m) << 2) | b
            at, hit = found_at(entries, key)
            key, at, left = key[hit], at[hit], side[hit] == 1
            # the left side is the mirror image's right side
            parts.append((own[hit], np.where(left, "left", "right"), np.array(list(S.BASES))[np.where(left, 3 - b, b)], np.minimum(key, mirrored(key, k)), n[at]))
        return [np.concatenate(c) for c in zip(*parts)]

    return match(counts, k, True, run, "kmer string, side string, base string, next string, count long")


def next_base_counts(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, base, n): which base follows each k-mer, both without other letters."""
    pairs = explode_kmers(reads, k + 1)
    return pairs.select(F.substring("kmer", 1, k).alias("kmer"), F.substring("kmer", k + 1, 1).alias("base")).groupBy("kmer", "base").agg(F.count("*").alias("n"))


def base_ranks(table: DataFrame) -> DataFrame:
    """Rank of each base in its context: most frequent first, then by letter."""
    return table.withColumn("rank", F.row_number().over(Window.partitionBy("kmer").orderBy(F.col("n").desc(), "base")) - 1)


def table_quality(table: DataFrame) -> DataFrame:
    """One row: n, conditional entropy and prediction accuracy of a next-base table."""
    c = table.groupBy("kmer").agg(F.sum("n").alias("t"), F.max("n").alias("top"), F.sum(F.col("n") * F.log2("n")).alias("w"))
    return c.agg(F.sum("t").alias("n"), ((F.sum(F.col("t") * F.log2("t")) - F.sum("w")) / F.sum("t")).alias("h"), (F.sum("top") / F.sum("t")).alias("accuracy"))


def table_cost(table: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """One row: bits of all following bases under the table's shares; 2 bits where a pair is unseen."""
    shares = table.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("kmer"))).select("kmer", "base", "p")
    wanted = next_base_counts(reads, k)
    return wanted.join(shares, ["kmer", "base"], "left").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce(-F.log2("p"), F.lit(2.0))).alias("bits"))


def rank_bases(reads: DataFrame, k: int) -> DataFrame:
    """(read_idx, pos, base, rank): each base's rank after its k-mer; 4 for a base without a clean context."""
    pairs = reads.select("read_idx", F.explode(S.kmers("sequence", k + 1)).alias("x")).select("read_idx", (F.col("x.pos") + k).alias("pos"), F.substring("x.kmer", 1, k).alias("kmer"), F.substring("x.kmer", k + 1, 1).alias("base"))
    ranks = base_ranks(next_base_counts(reads, k)).select("kmer", "base", "rank")
    ranks = F.broadcast(ranks) if k <= 8 else ranks  # 4 ** (k + 1) rows at most
    return pairs.join(ranks, ["kmer", "base"], "left").select("read_idx", "pos", "base", F.coalesce("rank", F.lit(4)).alias("rank"))


def frequency(values: DataFrame, column: str, top: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts of counts; coverage by the most frequent values; the most frequent values."""
    counts = values.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    of_counts = counts.groupBy("n").agg(F.count("*").alias("values"))
    run = Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, 0)  # over distinct counts
    covered = of_counts.select("n", "values", F.sum("values").over(run).alias("values_upto"), F.sum(F.col("n") * F.col("values")).over(run).alias("rows_upto"))
    return of_counts, covered, counts.orderBy(F.col("n").desc(), column).limit(top)


def reference_index(contigs: DataFrame, k: int, step: int = 1) -> DataFrame:
    """(kmer, contig_id, position, is_forward)."""
    rows = canonical_kmers(contigs.select(F.col("contig_id").alias("read_idx"), "sequence"), k, step)
    return rows.select("kmer", F.col("read_idx").alias("contig_id"), F.col("pos").alias("position"), "is_forward")


def capped_postings(index: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` postings of each k-mer, in order of contig and position."""
    return index.withColumn("__n", F.row_number().over(Window.partitionBy("kmer").orderBy("contig_id", "position"))).filter(F.col("__n") <= cap).drop("__n")


def map_reads(reads: DataFrame, contigs: DataFrame, k: int, most: int = 8, anchors: int = 4, step: int = 1, cap: int = 200) -> DataFrame:
    """Best place of each read: (read_idx, contig_id, position, is_rc, distance), null where it has none.

    Anchors are k-mers at equal distances; equi-join on the index, then Hamming distance over the whole
    read; the smallest distance wins, then contig, position and strand.  A k-mer offers its first ``cap`` places, so that
    repeats don't multiply reads by contigs.
    """
    n = F.length("sequence")
    last = n - k
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(anchors - 1)), lambda i: F.floor(last * i / (anchors - 1)).cast("int")))
    seeds = (
        reads.withColumn("sequence", F.upper("sequence")).filter(last >= 0).select("read_idx", "sequence", F.explode(at).alias("offset"))
        .withColumn("raw", F.substring("sequence", F.col("offset") + 1, F.lit(k))).filter(~F.col("raw").rlike("[^ACGT]"))
        .withColumn("kmer", F.least("raw", S.reverse_complement("raw"))).withColumn("forward", F.col("raw") == F.col("kmer"))
    )
    hits = seeds.join(capped_postings(reference_index(contigs, k, step), cap), "kmer")
    is_rc = F.col("forward") != F.col("is_forward")
    start = F.when(is_rc, F.col("position") - (n - k - F.col("offset"))).otherwise(F.col("position") - F.col("offset"))
    placed = hits.select("read_idx", "sequence", "contig_id", start.alias("position"), is_rc.alias("is_rc")).distinct()
    region = F.substring("reference", F.col("position") + 1, n)
    read = F.when(F.col("is_rc"), S.reverse_complement("sequence")).otherwise(F.col("sequence"))
    scored = (
        placed.join(contigs.select("contig_id", F.col("sequence").alias("reference")), "contig_id").filter((F.col("position") >= 0) & (F.col("position") + n <= F.length("reference")))
        .withColumn("distance", S.hamming_within(read, region, most)).filter(F.col("distance").isNotNull())
    )
    first = Window.partitionBy("read_idx").orderBy("distance", "contig_id", "position", "is_rc")
    best = scored.withColumn("__n", F.row_number().over(first)).filter("__n = 1").select("read_idx", "contig_id", "position", "is_rc", "distance")
    return reads.select("read_idx").join(best, "read_idx", "left")


def mapped_mismatches(mappings: DataFrame, reads: DataFrame, contigs: DataFrame) -> DataFrame:
    """Mappings with ``mismatches``: (pos, read base) on the read's strand."""
    rows = mappings.join(reads.select("read_idx", F.upper("sequence").alias("sequence")), "read_idx").join(contigs.select("contig_id", F.col("sequence").alias("reference")), "contig_id", "left")
    region = F.substring("reference", F.col("position") + 1, F.length("sequence"))
    own = F.when(F.col("is_rc"), S.reverse_complement(region)).otherwise(region)
    return rows.select("read_idx", "contig_id", "position", "is_rc", F.length("sequence").alias("length"), F.when(F.col("contig_id").isNotNull(), S.mismatches("sequence", own)).alias("mismatches"), F.when(F.col("contig_id").isNull(), F.col("sequence")).alias("raw"))


def hybrid_streams(encoded: DataFrame, contigs: DataFrame) -> DataFrame:
    """Encoded reads in long form (stream, read_idx, data): flags, singletons, mapping, distances between mismatches,
    their bases, and the consensus, whose rows are contigs."""
    placed, alone = encoded.filter("contig_id is not null"), encoded.filter("contig_id is null")
    one = lambda rows, name, data: rows.select(F.lit(name).alias("stream"), "read_idx", data.alias("data"))
    pos = F.transform("mismatches", lambda m: m["pos"])
    steps = F.transform(pos, lambda p, i: (p - F.when(i > 0, F.get(pos, i - 1)).otherwise(0)).cast("string"))
    return (
        one(encoded, "flags", F.when(F.col("contig_id").isNull(), "0").otherwise("1"))
        .unionByName(one(alone, "singletons", F.col("raw")))
        .unionByName(one(placed, "mapping", F.concat_ws(":", F.col("contig_id").cast("string"), F.col("position").cast("string"), F.col("is_rc").cast("string"))))
        .unionByName(one(placed, "positions", F.array_join(steps, ",")))
        .unionByName(one(placed, "bases", F.array_join(F.transform("mismatches", lambda m: m["base"]), "")))
        .unionByName(one(contigs.withColumnRenamed("contig_id", "read_idx"), "consensus", F.col("sequence")))
    )


def decode_mapped(encoded: DataFrame, contigs: DataFrame) -> DataFrame:
    """(read_idx, sequence) of encoded reads."""
    rows = encoded.join(contigs.select("contig_id", F.col("sequence").alias("reference")), "contig_id", "left")
    region = F.substring("reference", F.col("position") + 1, F.col("length"))
    own = F.when(F.col("is_rc"), S.reverse_complement(region)).otherwise(region)
    patched = lambda x: F.array_join(F.transform(F.sequence(F.lit(0), F.length(x["own"]) - 1), lambda i: F.coalesce(F.try_element_at(x["patch"], i), F.substring(x["own"], i + 1, F.lit(1)))), "")
    fixed = S.let(F.struct(own.alias("own"), F.map_from_entries("mismatches").alias("patch")), patched)
    return rows.select("read_idx", F.when(F.col("contig_id").isNull(), F.col("raw")).otherwise(fixed).alias("sequence"))


def with_neighbours(reads: DataFrame, k: int, w: int) -> DataFrame:
    """Reads that share a minimiser with another read (semi-join)."""
    posts = minimizer_postings(reads, k, w)
    shared = posts.groupBy("hash").agg(F.min("read_idx").alias("a"), F.max("read_idx").alias("b")).filter("a < b").select("hash")
    busy = posts.join(shared, "hash", "left_semi").select("read_idx").distinct()
    return reads.join(busy, "read_idx", "left_semi")


def isolated(reads: DataFrame, k: int, w: int) -> DataFrame:
    return reads.join(with_neighbours(reads, k, w).select("read_idx"), "read_idx", "left_anti")


def coded_minimizers(sequences: pa.Array, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, byte, is it the forward text) of the smallest, of equals the first, in every ``w`` neighbouring clean k-mers;
    each place once, by row and place; k at most 31."""
    offsets, parts = strings(sequences)[1], list(_both_codes(sequences, k))
    if not parts:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
    f, r, at = (np.concatenate(x) for x in zip(*parts))
    row, least = np.searchsorted(offsets, at, side="right") - 1, np.minimum(f, r)
    start = np.flatnonzero(row[w - 1 :] == row[: max(len(row) - w + 1, 0)])
    picked = start[:0]
    if len(start):
        picked = start + np.lib.stride_tricks.sliding_window_view(least, w)[start].argmin(1)
        picked = picked[np.append(True, picked[1:] != picked[:-1])]  # the places of windows never fall back
    return row[picked], least[picked], (at - offsets[row])[picked], (f <= r)[picked]


#: fixed value: reads whose minimisers are found at once
MINIMIZED = 1 << 14


def minimizer_postings(reads: DataFrame, k: int, w: int) -> DataFrame:
    """(hash, read_idx), distinct: read_idx is a key, so nothing is shuffled."""
    if k > 31:
        return reads.select("read_idx", F.explode(F.array_distinct(S.minimizers("sequence", k, w))).alias("hash"))

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, MINIMIZED):
                some = batch.slice(low, MINIMIZED)
                row, code, _, _ = coded_minimizers(some.column(1), k, w)
                order = np.lexsort([code, row])
                row, code = row[order], code[order]
                new = np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])) if len(row) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(row[new])), pa.array(code[new])], names=["read_idx", "hash"])

    return reads.select(F.col("read_idx").cast("long").alias("read_idx"), "sequence").mapInArrow(run, "read_idx long, hash long").select("hash", "read_idx")


def overlap_candidates(reads: DataFrame, k: int, w: int, least: int = 31, most: int = 4, cap: int = 200) -> DataFrame:
    """(a, b, is_rc, shift, overlap, distance): b, reverse-complemented where ``is_rc``, starts ``shift`` bases into a and
    extends it to the right, or to the left where shift is negative; they overlap by ``least`` bases or more and
    differ at ``most`` places.  Of a minimiser's reads the first ``cap`` meet."""
    # the k-mers that are minimisers of their own read: read_idx is a key, so nothing is joined
    own = S.let(F.struct(S.canonical_kmers("sequence", k).alias("all"), S.minimizers("sequence", k, w).alias("chosen")), lambda y: F.filter(y["all"], lambda x: F.array_contains(y["chosen"], x["hash"])))
    rows = reads.withColumn("sequence", F.upper("sequence")).select("read_idx", "sequence", F.explode(own).alias("x"))
    picked = rows.select("read_idx", "sequence", F.col("x.hash").alias("hash"), F.col("x.pos").alias("pos"), F.col("x.is_forward").alias("forward"))
    few = picked.withColumn("__n", F.row_number().over(Window.partitionBy("hash").orderBy("read_idx", "pos"))).filter(F.col("__n") <= cap)
    a, b = (few.select("hash", *[F.col(c).alias(f"{c}_{x}") for c in ("read_idx", "sequence", "pos", "forward")]) for x in "ab")
    is_rc = F.col("forward_a") != F.col("forward_b")
    oriented = F.when(is_rc, F.length("sequence_b") - F.col("pos_b") - k).otherwise(F.col("pos_b"))
    met = a.join(b.hint("merge"), "hash").filter(F.col("read_idx_a") != F.col("read_idx_b"))
    pairs = met.select("read_idx_a", "read_idx_b", "sequence_a", F.when(is_rc, S.reverse_complement("sequence_b")).otherwise(F.col("sequence_b")).alias("sequence_b"), is_rc.alias("is_rc"), (F.col("pos_a") - oriented).alias("shift")).distinct()
    right = F.col("shift") >= 0
    overlap = F.when(right, F.length("sequence_a") - F.col("shift")).otherwise(F.length("sequence_b") + F.col("shift"))
    other = F.when(right, F.length("sequence_b")).otherwise(F.length("sequence_a"))
    extends = (F.when(right, F.length("sequence_b") > F.col("overlap")).otherwise(True)) & (F.col("overlap") <= other)
    start = lambda c: F.when(right if c == "b" else ~right, F.lit(1)).otherwise(F.abs("shift") + 1)
    part = lambda c: F.substring(f"sequence_{c}", start(c), F.col("overlap"))
    return (
        pairs.withColumn("overlap", overlap).filter((F.col("overlap") >= least) & extends)
        .withColumn("distance", S.hamming_within(part("a"), part("b"), most)).filter("distance is not null")
        .select(F.col("read_idx_a").alias("a"), F.col("read_idx_b").alias("b"), "is_rc", "shift", "overlap", "distance")
    )

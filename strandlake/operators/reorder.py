"""Orders of reads and their permutations: every result has (chunk_id, new_pos, read_idx)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..session import keep

CHUNK = 2_500_000


def number(rows: DataFrame, keys: list[Column], name: str, columns: list[str]) -> DataFrame:
    """``columns`` of ``rows`` with their place from 0 in the order of ``keys``, which must settle every tie: a range-partitioned sort,
    then one count per partition; no task sees more than its range."""
    laid = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*columns, F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at"))
    laid = keep(laid, "ordered")
    parts = sorted(laid.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("low")).collect(), key=lambda r: r["__part"])
    before, shifts = 0, []
    for r in parts:
        shifts.append((r["__part"], before - r.low))
        before += r.n
    shift = F.broadcast(rows.sparkSession.createDataFrame(shifts, "__part int, __shift long"))  # a row per partition
    return laid.join(shift, "__part").withColumn(name, F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")


def _number(reads: DataFrame, keys: list[Column], chunk: int | None) -> DataFrame:
    """Places within chunks of reads, or over the whole table where ``chunk`` is None."""
    if chunk is None:
        return number(reads, [*keys, F.col("read_idx")], "new_pos", ["read_idx"]).select(F.lit(0).cast("long").alias("chunk_id"), "new_pos", "read_idx")
    w = Window.partitionBy("chunk_id").orderBy(*keys, "read_idx")
    return reads.withColumn("chunk_id", F.floor(F.col("read_idx") / chunk)).withColumn("new_pos", (F.col("chunk_id") * chunk + F.row_number().over(w) - 1).cast("long")).select("chunk_id", "new_pos", "read_idx")


def identity(reads: DataFrame, chunk: int | None = CHUNK) -> DataFrame:
    return reads.select((F.floor(F.col("read_idx") / chunk) if chunk else F.lit(0).cast("long")).alias("chunk_id"), F.col("read_idx").alias("new_pos"), "read_idx")


def similarity(reads: DataFrame, chunk: int | None = CHUNK) -> DataFrame:
    """By smallest syncmer, its position, and mean quality; reads without one last."""
    keyed = reads.withColumn("__s", S.min_syncmer("sequence")).withColumn("__q", S.mean_byte("quality"))
    return _number(keyed, [F.col("__s.hash").asc_nulls_last(), F.col("__s.pos").asc_nulls_last(), F.col("__q")], chunk)


def similarity_global(reads: DataFrame, partitions: int | None = None) -> DataFrame:
    """The same key over the whole table as a range-partitioned sort: rows in order, not numbered."""
    keyed = reads.withColumn("__s", S.min_syncmer("sequence")).withColumn("__q", S.mean_byte("quality"))
    keys = [F.col("__s.hash").asc_nulls_last(), F.col("__s.pos").asc_nulls_last(), F.col("__q"), F.col("read_idx")]
    spread = keyed.repartitionByRange(partitions, *keys) if partitions else keyed.repartitionByRange(*keys)
    return spread.sortWithinPartitions(*keys).drop("__s", "__q")


def center(reads: DataFrame, chunk: int | None = CHUNK) -> DataFrame:
    """Reads with the same left centre window stand together at the first one's place."""
    keyed = reads.withColumn("chunk_id", F.floor(F.col("read_idx") / chunk) if chunk else F.lit(0)).withColumn("__w", S.center_windows("sequence")["left"])
    group = F.when(F.col("__w").isNotNull(), F.min("read_idx").over(Window.partitionBy("chunk_id", "__w"))).otherwise(F.col("read_idx"))
    return _number(keyed.withColumn("__g", group), [F.col("__g")], chunk)


def by_component(reads: DataFrame, components: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Members of a component (read_idx, label) stand together at the smallest one's place."""
    keyed = reads.join(components, "read_idx", "left").withColumn("__g", F.coalesce("label", "read_idx"))
    return _number(keyed, [F.col("__g")], chunk)


def apply(reads: DataFrame, permutation: DataFrame) -> DataFrame:
    """Reads with their new_pos."""
    return reads.join(permutation.select("read_idx", "new_pos").hint("merge"), "read_idx")


def inverse(permutation: DataFrame) -> DataFrame:
    """Where each read came from: the permutation with its two columns exchanged."""
    return permutation.select("chunk_id", F.col("read_idx").alias("new_pos"), F.col("new_pos").alias("read_idx"))


#: sort keys by name; each takes a column name and gives key columns
STRATEGIES = {
    "lexicographic": lambda c: [F.col(c)],
    "mean": lambda c: [S.mean_byte(c)],
    "norm": lambda c: [S.norm2(c)],
    "mean_variance": lambda c: [S.mean_byte(c), S.byte_variance(c)],
    "mean_min": lambda c: [S.mean_byte(c), F.array_min(S.byte_values(c))],
    "profile8": lambda c: [S.profile(c, 8)],
    "profile16": lambda c: [S.profile(c, 16)],
    "ends": lambda c: [S.ends_key(c)],
    "strand_lexicographic": lambda c: [S.canonical(c)["sequence"]],
    "minimizer": lambda c: [S.min_kmer(c).asc_nulls_last()],
    "syncmer": lambda c: [S.min_syncmer(c)["hash"].asc_nulls_last()],
    "closed_syncmer": lambda c: [F.array_min(F.transform(S.syncmers(c, 31, 10, (0, 21)), lambda x: x["hash"])).asc_nulls_last()],
    "syncmer_suffix": lambda c: [S.min_syncmer(c)["hash"].asc_nulls_last(), F.substring(F.col(c), S.min_syncmer(c)["pos"] + 1, F.length(c))],
    "sketch4": lambda c: [S.bottom_sketch(F.transform(S.canonical_kmers(c, 21), lambda x: x["hash"]), 4)],
    "sketch8": lambda c: [S.bottom_sketch(F.transform(S.canonical_kmers(c, 21), lambda x: x["hash"]), 8)],
}


def sweep_keys(name: str, column: str) -> list[Column]:
    """Keys ``kind:k`` of the sweep over k-mer lengths: smallest ``open`` or ``closed`` syncmer, the two smallest closed
    ones (``top2``), the smallest closed one with its place (``placed``), and ``kmer``, the smallest k-mer."""
    kind, k = name.split(":")[0], int(name.split(":")[1])
    if kind == "kmer":
        return [S.min_kmer(column, k).asc_nulls_last()]
    found = S.syncmers(column, k, 10, (0,) if kind == "open" else (0, k - 10))
    hashes = F.transform(found, lambda x: x["hash"])
    if kind == "top2":
        two = F.slice(F.array_sort(F.array_distinct(hashes)), 1, 2)
        return [F.get(two, F.lit(i)).asc_nulls_last() for i in (0, 1)]
    if kind == "placed":
        low = F.array_min(F.transform(found, lambda x: F.struct(x["hash"].alias("hash"), x["pos"].alias("pos"))))
        return [low["hash"].asc_nulls_last(), low["pos"].asc_nulls_last()]
    return [F.array_min(hashes).asc_nulls_last()]


def by_strategy(reads: DataFrame, strategy: str, column: str = "quality", chunk: int | None = CHUNK) -> DataFrame:
    """Order by a named key of one column, or of both with ``column='both'``; ``kind:k`` names a key of the sweep."""
    kind, _, k = strategy.partition(":")
    if strategy not in STRATEGIES and not (kind in ("open", "closed", "top2", "placed", "kmer") and k.isdigit() and 10 < int(k) < 32):
        raise ValueError(f"sort strategy {strategy!r}")
    columns = ["sequence", "quality"] if column == "both" else [column]
    keys = [x for c in columns for x in (sweep_keys(strategy, c) if k else STRATEGIES[strategy](c))]
    return _number(reads, keys, chunk)


def mean_sorted(reads: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Stable order by mean quality."""
    return by_strategy(reads, "mean", "quality", chunk)


def in_blocks(reads: DataFrame, strategy: str, block: int, column: str = "quality") -> DataFrame:
    """Order within fixed blocks of reads."""
    return by_strategy(reads, strategy, column, block)


def encoded_sizes(permutation: DataFrame) -> DataFrame:
    """One row: bytes of the permutation as zigzag varint deltas forward and inverse, as plain 4-byte
    numbers, and as recomputable keys of 1 and 3 bytes."""
    size = lambda frame, value, order: frame.withColumn("d", F.col(value) - F.lag(value, 1, 0).over(Window.partitionBy("chunk_id").orderBy(order))).agg(F.sum(S.varint_size(S.zigzag("d"))).cast("long").alias("b"), F.count("*").alias("n"))
    forward = size(permutation, "read_idx", "new_pos").select(F.col("b").alias("forward"), "n")
    backward = size(permutation, "new_pos", "read_idx").select(F.col("b").alias("inverse"))
    return forward.crossJoin(backward).select("forward", "inverse", (4 * F.col("n")).alias("raw"), F.col("n").alias("mean_key"), (3 * F.col("n")).alias("mean_variance_key"))

"""``compress`` and ``decompress``: text files to archives and back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..session import scratch
from ..sources import archive, fastq

#: fixed values: reads per chunk by level
ULTRA_CHUNKS = {1: 1_000_000, 2: 2_000_000, 3: 5_000_000, 4: 8_000_000, 5: 10_000_000}
MODEL_LEAST_READS = 100_000


@dataclass(frozen=True)
class Options:
    fasta: bool = False
    quality: str = "lossless"
    no_quality: bool = False
    reorder: str | None = None  # local, global
    local_reorder: bool = False
    ultra: int | None = None  # 1 to 5; 0 chooses
    order: str = "identity"  # of ultra: identity, center, similarity
    inline_delta: bool = False
    hints: bool = False
    canonical: bool = False
    quality_codec: str = "plain"  # plain, delta, model
    chunk: int = 2_500_000
    level: int = 3

    def check(self) -> None:
        """Raise ``ValueError`` where options exclude each other."""
        ways = [n for n, on in (("reorder", self.reorder), ("local_reorder", self.local_reorder), ("ultra", self.ultra is not None), ("inline_delta", self.inline_delta), ("hints", self.hints), ("canonical", self.canonical)) if on]
        if len(ways) > 1:
            raise ValueError(f"{' and '.join(ways)} exclude each other")
        if self.reorder not in (None, "local", "global"):
            raise ValueError("reorder is local or global")
        if self.quality not in archive.BINNINGS:
            raise ValueError(f"quality mode {self.quality!r}")
        if self.quality_codec not in ("plain", "delta", "model"):
            raise ValueError(f"quality codec {self.quality_codec!r}")
        if self.no_quality and self.quality_codec != "plain":
            raise ValueError("no_quality leaves nothing for a quality codec")
        if self.ultra is not None and self.ultra not in range(6):
            raise ValueError("ultra level 0 to 5")
        if self.chunk < 1:
            raise ValueError("chunk is positive")
        if not 1 <= self.level <= 22:
            raise ValueError("level 1 to 22")


def ultra_level(cores: int, free_bytes: int) -> int:
    """Level by cores and memory: 1,500 bytes a read of a chunk, in 80 % of what is free."""
    by_cores = 1 if cores < 4 else 2 if cores < 8 else 3 if cores < 16 else 5
    return max([n for n, c in ULTRA_CHUNKS.items() if n <= by_cores and c * 1500 <= 0.8 * free_bytes], default=1)


def compress(spark: SparkSession, source: str | list[str], target: str, options: Options = Options()) -> None:
    options.check()
    reads = fastq.read_fastq(spark, source, options.fasta)
    quality = "discard" if options.no_quality else options.quality
    encoding, order, chunk = "raw", "identity", options.chunk
    if options.ultra is not None:
        level = options.ultra or ultra_level(spark.sparkContext.defaultParallelism, 8 << 30)
        encoding, order, chunk = "ordered", options.order, ULTRA_CHUNKS[level]
    elif options.local_reorder:
        encoding, order = "local_delta", "center"
    elif options.reorder:
        encoding, order, chunk = "ordered", "similarity", options.chunk if options.reorder == "local" else None
    elif options.inline_delta:
        encoding = "inline_delta"
    elif options.hints:
        encoding = "hints"
    elif options.canonical:
        encoding = "canonical"
    with scratch(spark):
        archive.write_archive(reads, target, encoding, quality, options.quality_codec, order, chunk, options.fasta, options.level)


def decompress(spark: SparkSession, source: str, target: str, compress_text: bool = False, level: int | None = None, single_file: bool = False) -> None:
    """Text in the original order, as ordered part files or one file; ``-`` writes to standard output."""
    meta = archive.read_meta(spark, source)
    reads = archive.read_archive(spark, source)
    if target == "-":
        fastq.write_stdout(reads, meta["fasta"])
    else:
        fastq.write_fastq(reads, target, meta["fasta"], compress_text, level, single_file)


#: fixed values: encodings and codecs that the reads of an archive can be decoded from one after another
STREAMED_ENCODINGS = ("raw", "hints", "canonical")


def can_stream(meta: dict) -> bool:
    """Whether an archive's reads come back one by one, without a chunk's other reads, a model or an order."""
    return meta["encoding_type"] in [archive.ENCODINGS[e] for e in STREAMED_ENCODINGS] and meta["quality_codec"] in (archive.QUALITY_CODECS["plain"], archive.QUALITY_CODECS["none"])


def choose_quality_codec(reads, quality: str = "lossless", explicit: bool = False) -> str:
    """``context`` where reads are lossless and many, or where asked for; else ``plain``."""
    if quality != "lossless":
        return "plain"
    return "context" if explicit or reads.agg(F.count("*")).first()[0] >= MODEL_LEAST_READS else "plain"

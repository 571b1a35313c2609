"""The assembling codec as one job: match reads, build contigs, place reads on them, and store every stream in the
order of the contigs; then back, in the reads' own order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assembly, clusters, kmers, pairs, reorder
from ..session import keep, scratch


def assemble(reads: DataFrame, k: int = 15, most: int = 24) -> tuple[DataFrame, DataFrame]:
    """Contigs (contig_id, sequence), and reads as places on them with mismatches, or raw where no contig is near.

    Reads that match at a shift form components; contigs grow greedily within a component.
    """
    checked = pairs.preprocess(reads.select("read_idx", "sequence"))
    clean = checked.filter("not has_n").select("read_idx", "sequence")
    labels = clusters.components(keep(pairs.match_candidates(clean).select("a", "b").distinct(), "matches"))
    contigs = keep(assembly.greedy_contigs(clean, labels).select("contig_id", "sequence"), "contigs")
    return contigs, kmers.mapped_mismatches(kmers.map_reads(reads, contigs, k, most), reads, contigs)


def write_chain(reads: DataFrame, path: str) -> None:
    """Contigs, and one table of reads in the order of their places, so that near reads lie together in every column."""
    with scratch(reads.sparkSession):
        contigs, encoded = assemble(reads)
        encoded = keep(encoded, "encoded")
        place = reorder.number(encoded, [F.col("contig_id").asc_nulls_last(), F.col("position"), F.col("read_idx")], "new_pos", ["read_idx"])
        contigs.write.option("compression", "zstd").parquet(f"{path}/contigs")
        rows = encoded.join(place, "read_idx").join(reads.select("read_idx", "id", "quality"), "read_idx")
        rows.repartitionByRange("new_pos").sortWithinPartitions("new_pos").write.option("compression", "zstd").parquet(f"{path}/reads")


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    """(read_idx, id, sequence, quality)."""
    rows = spark.read.parquet(f"{path}/reads")
    return kmers.decode_mapped(rows, spark.read.parquet(f"{path}/contigs")).join(rows.select("read_idx", "id", "quality"), "read_idx").select("read_idx", "id", "sequence", "quality")

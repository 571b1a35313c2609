"""The archive: a folder of Parquet streams and a one-row table that describes them.

Encodings: 0 raw, 4 a hint byte before each read, 5 inline delta, 6 canonical strand with flags,
8 local order with previous-read delta, 9 stored in another order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality as Q
from ..functions import sequence as S
from ..operators import delta, reorder

MAGIC, VERSION = "SL", 1
WHOLE = 1 << 40
#: fixed value: reads of a chunk that are laid out by one task
SLICE = 1 << 16
ENCODINGS = {"raw": 0, "hints": 4, "inline_delta": 5, "canonical": 6, "local_delta": 8, "ordered": 9}
BINNINGS = {"lossless": 0, "illumina_bin": 1, "discard": 2, "binary": 3, "four_level": 4, "illumina_bin_std": 5}
QUALITY_CODECS = {"plain": 0, "delta": 1, "model": 2, "none": 3}
META = "magic string, version int, encoding_type int, flags int, binning int, quality_codec int, chunk long, num_reads long, const_seq_len int, const_qual_len int, fasta boolean"


def write_archive(reads: DataFrame, path: str, encoding: str = "raw", quality: str = "lossless", quality_codec: str = "plain", order: str = "center", chunk: int | None = 2_500_000, fasta: bool = False, level: int = 3) -> None:
    """Write ``reads``; overwrites nothing.  Without ``chunk`` an order is one over the whole table."""
    for name, table in ((encoding, ENCODINGS), (quality, BINNINGS), (quality_codec, QUALITY_CODECS)):
        if name not in table:
            raise ValueError(f"unknown option {name!r}")
    if chunk is None and encoding != "ordered":
        raise ValueError(f"{encoding} needs chunks")
    spark, part, chunk = reads.sparkSession, chunk, chunk or WHOLE
    if fasta or quality == "discard":
        quality_codec = "none"
    kept = reads.withColumn("quality", F.lit(None).cast("string") if quality_codec == "none" else Q.quantize("quality", quality))
    body = kept.withColumn("chunk_id", F.floor(F.col("read_idx") / chunk))
    n_letters = F.upper("sequence")
    if encoding == "raw":
        body = body.withColumn("data", F.col("sequence"))
    elif encoding == "hints":
        body = body.withColumn("data", F.col("sequence")).withColumn("hint", S.hint_byte("sequence"))
    elif encoding == "inline_delta":
        d = delta.inline_delta(kept, chunk).select("read_idx", "base_idx", F.col("delta").alias("data"))
        body = body.join(d.hint("merge"), "read_idx")
    elif encoding == "canonical":
        # strands come back only for plain upper-case letters: others are kept as they are
        plain = F.col("sequence") == F.regexp_replace(n_letters, "[^ACGTN]", "")
        c = S.canonical("sequence")
        body = body.withColumn("reversed", plain & c["was_reversed"]).withColumn("data", F.when(plain, c["sequence"]).otherwise(F.col("sequence")))
    else:
        orders = {"center": reorder.center, "similarity": reorder.similarity, "identity": reorder.identity}
        if order not in orders:
            raise ValueError(f"unknown order {order!r}")
        placed = reorder.apply(body, orders[order](kept, part))
        if encoding == "local_delta":
            upper = placed.withColumn("sequence", F.col("sequence"))
            d = delta.previous_read_delta(upper, "new_pos", chunk).select("read_idx", F.col("delta").alias("data"))
            body = placed.join(d.hint("merge"), "read_idx")
            odd = body.filter(F.col("sequence").rlike("[^ACGTN]")).limit(1).count()
            if odd:
                raise ValueError("local_delta needs sequences of A, C, G, T and N")
        else:
            body = placed.withColumn("data", F.col("sequence"))
    if quality_codec == "delta":
        body = delta.with_quality_delta(body, "qdata").drop("quality")
    elif quality_codec == "model":
        delta.quality_model(kept).write.parquet(f"{path}/model")
        body = body.withColumn("qdata", delta.model_residuals("quality", spark.read.parquet(f"{path}/model"))).drop("quality")
    body = body.drop("sequence")
    if encoding in ("inline_delta", "local_delta", "ordered") or quality_codec == "delta":
        # a shuffle has dealt each chunk to all tasks: bring its reads together again, in the order they are stored in
        place = "new_pos" if "new_pos" in body.columns else "read_idx"
        body = body.repartition("chunk_id", F.floor(F.col(place) / SLICE)).sortWithinPartitions("chunk_id", place)
    # the chunk is a column, not a folder: the number of files follows the bytes, not chunks by tasks
    body.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(f"{path}/streams")
    same = lambda c: F.coalesce(F.when(F.min(F.length(c)) == F.max(F.length(c)), F.min(F.length(c))), F.lit(0)).cast("int")
    meta = kept.agg(F.count("*").alias("num_reads"), same("sequence").alias("const_seq_len"), same("quality").alias("const_qual_len")).select(
        F.lit(MAGIC).alias("magic"), F.lit(VERSION).alias("version"), F.lit(ENCODINGS[encoding]).alias("encoding_type"), F.when((F.col("const_seq_len") > 0), 2).otherwise(0).alias("flags"),
        F.lit(BINNINGS[quality]).alias("binning"), F.lit(QUALITY_CODECS[quality_codec]).alias("quality_codec"), F.lit(chunk).cast("long").alias("chunk"), "num_reads", "const_seq_len", "const_qual_len", F.lit(fasta).alias("fasta"),
    )
    meta.coalesce(1).write.json(f"{path}/meta")


def read_meta(spark: SparkSession, path: str) -> dict:
    """The archive's description; raises ``ValueError`` if it is not one that can be read."""
    try:
        rows = spark.read.schema(META).json(f"{path}/meta").collect()
    except Exception as e:
        raise ValueError(f"no archive at {path}") from e
    if len(rows) != 1:
        raise ValueError("archive without a description")
    m = rows[0].asDict()
    if m["magic"] != MAGIC or m["version"] != VERSION:
        raise ValueError("unknown archive format or version")
    for key, table in (("encoding_type", ENCODINGS), ("binning", BINNINGS), ("quality_codec", QUALITY_CODECS)):
        if m[key] not in table.values():
            raise ValueError(f"unknown {key} {m[key]}")
    if m["num_reads"] is None or m["num_reads"] < 0 or not m["chunk"] or m["chunk"] <= 0:
        raise ValueError("archive description out of range")
    return m


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The read table (unordered rows with read_idx).  A wrong number of reads raises."""
    m = read_meta(spark, path)
    try:
        body = spark.read.parquet(f"{path}/streams")
    except Exception as e:
        if m["num_reads"] == 0:
            return spark.createDataFrame([], "read_idx long, id string, sequence string, quality string")
        raise ValueError("archive without streams") from e
    if body.count() != m["num_reads"]:  # from the Parquet footers
        raise ValueError("archive is cut off: number of reads differs")
    kind = {v: k for k, v in ENCODINGS.items()}[m["encoding_type"]]
    if kind == "inline_delta":
        s = delta.undo_inline_delta(body.select("read_idx", "base_idx", F.col("data").alias("delta")), m["chunk"])
        body = body.join(s.hint("merge"), "read_idx")
    elif kind == "local_delta":
        s = delta.undo_previous_read_delta(body.select("chunk_id", "read_idx", "new_pos", F.col("data").alias("delta")), "new_pos")
        body = body.join(s.hint("merge"), "read_idx")
    elif kind == "canonical":
        body = body.withColumn("sequence", S.restore_strand("data", "reversed"))
    else:
        body = body.withColumn("sequence", F.col("data"))
    codec = {v: k for k, v in QUALITY_CODECS.items()}[m["quality_codec"]]
    if codec == "delta":
        body = delta.undo_quality_delta(body.select("chunk_id", "read_idx", F.col("qdata").alias("deltas"), "id", "sequence"), ("id", "sequence"))
    elif codec == "model":
        body = body.withColumn("quality", F.coalesce(delta.undo_model_residuals("qdata", spark.read.parquet(f"{path}/model")), F.lit("")))
    return body.select("read_idx", "id", "sequence", "quality")


def size_statistics(reads: DataFrame) -> DataFrame:
    """(stream, bytes, share): characters of each stream."""
    one = reads.agg(*[F.coalesce(F.sum(F.length(c)), F.lit(0)).cast("long").alias(c) for c in ("id", "sequence", "quality")])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("stream"), F.col(c).alias("bytes")) for n, c in (("header", "id"), ("sequence", "sequence"), ("quality", "quality"))])).alias("x")).select("x.*")
    total = one.select((F.col("id") + F.col("sequence") + F.col("quality")).alias("total"))
    return long.crossJoin(total).select("stream", "bytes", F.when(F.col("total") > 0, F.col("bytes") / F.col("total")).otherwise(0.0).alias("share"))  # one row


def archive_size(spark: SparkSession, path: str) -> int:
    """Bytes on disk."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()

"""FASTQ and FASTA text: scan, sink, and the standard streams.

Lines are numbered over the whole file from their order within each input block and one count per
block, so plain files are read in parallel; gzip files, known by their first bytes, are one task each, as a stream.
"""

from __future__ import annotations

import os
import shutil
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


#: fixed values: names of the gzip levels 0 to 9
GZIP_LEVELS = ("NO_COMPRESSION", "BEST_SPEED", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "BEST_COMPRESSION")


def is_gzip(spark: SparkSession, path: str) -> bool:
    """First bytes 1f 8b, read through the file system that the path names."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return stream.read() == 0x1F and stream.read() == 0x8B
    finally:
        stream.close()


def _plain_name(spark: SparkSession, path: str) -> str:
    """``path``, or for gzip under another name a copy in the shared folder that Spark's reader unpacks as a stream."""
    if path.endswith(".gz") or not is_gzip(spark, path):
        return path
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/unpacked-{uuid.uuid4().hex}.gz")
    jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf)
    return b.toString()


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value, first, last): lines numbered from 0, with the first line of their input block and of the next one."""
    raw = spark.read.text(_plain_name(spark, path)).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"))
    blocks = sorted(raw.groupBy("block").agg(F.count("*").alias("n"), F.min("mid").alias("low")).collect(), key=lambda r: r.block)
    at, rows = 0, []
    for b in blocks:
        rows.append((b.block, at - b.low, at, at + b.n))
        at += b.n
    shift = spark.createDataFrame(rows, "block long, shift long, first long, last long")  # a row per input block
    return raw.join(F.broadcast(shift), "block").select((F.col("mid") + F.col("shift")).alias("line"), F.rtrim("value", F.lit("\r")).alias("value"), "first", "last")


def _whole_records(size: int):
    """Consecutive lines in, one row per ``size`` lines out."""

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            n = table.num_rows // size * size
            line, value = table.column("line").to_numpy(), table.column("value")
            if (line[:n:size] % size).any() or (line[size - 1 : n : size] - line[:n:size] != size - 1).any():
                raise ValueError("lines of a block are out of order")
            yield pa.RecordBatch.from_arrays(
                [pa.array(line[:n:size] // size), *(value.take(pa.array(np.arange(k, n, size))).combine_chunks() for k in range(size)), pa.array(np.full(n // size, size))],
                names=["read_idx", *(f"f{k}" for k in range(size)), "n"],
            )
            rest = table.slice(n).to_batches()[0] if n < table.num_rows else None
        if rest is not None:
            raise ValueError("lines of a block are out of order")

    return run


def _records(lines: DataFrame, size: int) -> DataFrame:
    """(read_idx, f0, f1, ..., n).  Records that lie within an input block are put together where they are read; only
    lines of records that cross a border are shuffled."""
    start = F.floor(F.col("line") / size) * size
    inside = (start >= F.col("first")) & (start + size <= F.col("last"))
    schema = "read_idx long, " + ", ".join(f"f{k} string" for k in range(size)) + ", n long"
    whole = lines.filter(inside).select("line", "value").mapInArrow(_whole_records(size), schema)
    field = lambda k: F.max(F.when(F.col("line") % size == k, F.col("value"))).alias(f"f{k}")
    split = lines.filter(~inside).groupBy(F.floor(F.col("line") / size).alias("read_idx")).agg(*[field(k) for k in range(size)], F.count("*").alias("n"))
    return whole.unionByName(split)


def read_fastq(spark: SparkSession, paths: str | list[str], fasta: bool = False) -> DataFrame:
    """The read table of one file.  Wrong separators, cut-off records and unequal lengths raise when read."""
    if not isinstance(paths, str):
        if len(paths) != 1:
            raise ValueError("exactly one input file is supported; paired files go through operators.pairs")
        paths = paths[0]
    if paths == "-":
        paths = spool_stdin(spark)
    size = 2 if fasta else 4
    rows = _records(_lines(spark, paths), size)
    rows = rows.filter((F.col("n") > 1) | (F.col("f0") != ""))
    bad = lambda why: F.concat(F.lit(f"{why} in record "), F.col("read_idx").cast("string"))
    mark = ">" if fasta else "@"
    problem = F.when(F.col("n") < size, bad("unexpected end of file"))
    if not fasta:
        problem = problem.when(~F.col("f2").startswith("+"), bad("no + line")).when(F.length("f1") != F.length("f3"), bad("sequence and quality differ in length"))
    problem = problem.when(~F.substring("f0", 1, 1).isin(mark, "@"), bad(f"no {mark} line"))
    checked = F.when(problem.isNull(), F.col("f0")).otherwise(F.raise_error(problem).cast("string"))
    return rows.select("read_idx", checked.alias("id"), F.col("f1").alias("sequence"), (F.lit(None).cast("string") if fasta else F.col("f3")).alias("quality"))


def as_text(reads: DataFrame, fasta: bool = False) -> DataFrame:
    """(read_idx, value): a record's lines.  FASTA has two, so that it comes back as it went in."""
    lines = ["id", "sequence"] if fasta else ["id", "sequence", F.lit("+"), F.coalesce("quality", F.lit(""))]
    return reads.select("read_idx", F.concat_ws("\n", *lines).alias("value"))


def write_fastq(reads: DataFrame, path: str, fasta: bool = False, compress: bool = False, level: int | None = None, single_file: bool = False) -> None:
    """Text in read order: ordered part files, or one file, joined from them.  ``level`` 0 to 9 sets the gzip level."""
    if level is not None and not 0 <= level <= 9:
        raise ValueError("gzip level 0 to 9")
    text = as_text(reads, fasta).repartitionByRange("read_idx").sortWithinPartitions("read_idx")
    writer = text.select("value").write.mode("errorifexists")
    if compress:
        writer = writer.option("compression", "gzip")
        if level is not None:
            writer = writer.option("zlib.compress.level", GZIP_LEVELS[level])
    if not single_file:
        writer.text(path)
        return
    spark = reads.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(conf).exists(target):
        raise FileExistsError(path)
    parts = f"{path.rstrip('/')}-parts-{uuid.uuid4().hex}"
    writer.text(parts)
    _join_parts(spark, parts, f"{path}/part-00000.txt{'.gz' if compress else ''}")


def _join_parts(spark: SparkSession, folder: str, path: str) -> None:
    """The part files of ``folder``, one after another, as one file; gzip members follow each other as well."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(path)
    fs = source.getFileSystem(conf)
    out = target.getFileSystem(conf).create(target, False)
    try:
        for name in sorted(f.getPath().getName() for f in fs.listStatus(source) if f.getPath().getName().startswith("part-")):
            part = fs.open(jvm.org.apache.hadoop.fs.Path(source, name))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
            finally:
                part.close()
    finally:
        out.close()
    fs.delete(source, True)


def spool_stdin(spark: SparkSession) -> str:
    """Standard input as a file in the shared folder."""
    with tempfile.NamedTemporaryFile(delete=False, suffix=".fastq") as f:
        shutil.copyfileobj(sys.stdin.buffer, f)
    p = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(shared_dir(spark), os.path.basename(f.name)))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(True, True, spark._jvm.org.apache.hadoop.fs.Path("file://" + f.name), p)
    return p.toString()


def write_stdout(reads: DataFrame, fasta: bool = False) -> None:
    """Records in order, one partition at a time through the driver."""
    for row in as_text(reads, fasta).orderBy("read_idx").select("value").toLocalIterator():
        sys.stdout.write(row.value + "\n")

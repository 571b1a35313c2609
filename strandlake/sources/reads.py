"""The read table, and a deterministic read table derived from ``orders`` for driver queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: row order is explicit: every operator that depends on it uses ``read_idx``
READS = T.StructType([
    T.StructField("read_idx", T.LongType(), False), T.StructField("id", T.StringType(), False),
    T.StructField("sequence", T.StringType(), False), T.StructField("quality", T.StringType(), True),
])

_HEX = "0123456789abcdef"

#: the derived table; the text runs in Spark and in DuckDB
READS_SQL = f"""
  SELECT o_orderkey AS read_idx,
         concat('@SIM:1:FC:', CAST(1 + o_orderkey % 4 AS VARCHAR(9)), ':', CAST(1101 + o_orderkey % 16 AS VARCHAR(9)), ':',
                CAST(1000 + (o_orderkey * 7919) % 30000 AS VARCHAR(9)), ':', CAST(1000 + (o_orderkey * 104729) % 30000 AS VARCHAR(9)), ' 1:N:0:ATCACG') AS id,
         translate(concat(md5(CAST(o_custkey AS VARCHAR(20))), md5(concat('b', CAST(o_custkey AS VARCHAR(20))))), '{_HEX}', 'ACGTACGTACGTACGN') AS sequence,
         translate(concat(md5(CAST(o_orderkey AS VARCHAR(20))), md5(concat('q', CAST(o_orderkey AS VARCHAR(20))))), '{_HEX}', '#,5:<>?BDFGHIIII') AS quality
  FROM orders"""

#: the same reads with one base changed, so that similar reads differ
MUTATED_SQL = """
  SELECT read_idx, id,
         concat(substring(sequence, 1, CAST(read_idx % 64 AS INT)), substring('ACGT', 1 + CAST((read_idx * 7) % 4 AS INT), 1), substring(sequence, 2 + CAST(read_idx % 64 AS INT), 64)) AS sequence, quality
  FROM reads"""


def derived_reads(spark: SparkSession, sf_dir: str, mutated: bool = False) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    reads = spark.sql(READS_SQL.replace("FROM orders", "FROM {orders}"), orders=orders)
    return spark.sql(MUTATED_SQL.replace("FROM reads", "FROM {reads}"), reads=reads) if mutated else reads


def bases(reads: DataFrame, quality: bool = True, context: bool | Sequence[str] = False, following: int = 0, beside: Sequence[str] = ()) -> DataFrame:
    """(read_idx, pos, base, phred): one row per base.

    ``context`` adds the scores and bases around it, taken from the read's arrays before they are exploded, so that
    nothing is shuffled: q1, q2 (0 before the start), b1, b2, b3 and n1 (N outside), or those that it names (also b4).
    ``following`` adds next1, next2, ... up to that many scores, null behind the end; ``beside`` the letters of texts
    that stand base by base beside the sequence.
    """
    rows = reads.filter(F.length("sequence") > 0).select("read_idx", F.split("sequence", "").alias("base"), *[F.split(c, "").alias(c) for c in beside], *([F.transform(F.split("quality", ""), lambda x: F.ascii(x) - 33).alias("phred")] if quality else []))
    n = F.size("base")
    columns = {"base": F.col("base")} | {c: F.slice(c, F.lit(1), n) for c in beside}
    if quality:
        scores = F.coalesce("phred", F.array().cast("array<int>"))
        columns["phred"] = F.slice(scores, F.lit(1), n)
        for k in range(1, following + 1):
            columns[f"next{k}"] = F.slice(scores, F.lit(k + 1), n)
    if context:
        before = lambda c, k, fill: F.slice(F.concat(F.array(*[F.lit(fill)] * k), c), F.lit(1), n)
        around = {f"q{k}": before(scores, k, 0) for k in (1, 2)} if quality else {}
        around |= {f"b{k}": before(F.col("base"), k, "N") for k in (1, 2, 3, 4)}
        around["n1"] = F.concat(F.slice("base", F.lit(2), n), F.array(F.lit("N")))
        columns |= {c: a for c, a in around.items() if c != "b4"} if context is True else {c: around[c] for c in context}
    zipped = rows.select("read_idx", F.arrays_zip(*[c.alias(name) for name, c in columns.items()]).alias("zipped"))
    names = [f.name for f in zipped.schema["zipped"].dataType.elementType.fields]
    return zipped.select("read_idx", F.posexplode("zipped").alias("pos", "b")).select("read_idx", "pos", *[F.col("b")[old].alias(new) for old, new in zip(names, columns)])


def chunk_stats(reads: DataFrame, size: int = 2_500_000) -> DataFrame:
    """Per chunk of rows: reads, bases and size of the text."""
    text = F.length("id") + F.length("sequence") + F.coalesce(F.length("quality"), F.lit(0)) + 3
    return reads.groupBy(F.floor(F.col("read_idx") / size).alias("chunk_id")).agg(F.count("*").alias("reads"), F.sum(F.length("sequence")).alias("bases"), F.sum(text).alias("bytes"))


def constant_lengths(reads: DataFrame) -> DataFrame:
    """One row: the length of all sequences and of all qualities, 0 where they vary."""
    same = lambda c: F.when(F.min(F.length(c)) == F.max(F.length(c)), F.min(F.length(c))).otherwise(0)
    return reads.agg(F.coalesce(same("sequence"), F.lit(0)).alias("const_seq_len"), F.coalesce(same("quality"), F.lit(0)).alias("const_qual_len"))


def streams(reads: DataFrame) -> DataFrame:
    """Long form (stream, read_idx, data)."""
    one = lambda name, c: reads.select(F.lit(name).alias("stream"), "read_idx", F.col(c).cast("binary").alias("data"))
    return one("header", "id").unionByName(one("sequence", "sequence")).unionByName(one("quality", "quality"))


def split_by_n(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads without N, and reads with it."""
    has = F.contains(F.upper("sequence"), F.lit("N"))
    return reads.filter(~has), reads.filter(has)


def first_reads(reads: DataFrame, n: int, clean: bool = True) -> DataFrame:
    """The first n reads (without N), by read_idx."""
    rows = reads.filter(~F.contains("sequence", F.lit("N"))) if clean else reads
    return rows.orderBy("read_idx").limit(n)


def read_range(reads: DataFrame, start: int, end: int) -> DataFrame:
    """Reads start to end, counted from 1; reaches the Parquet scan as a filter."""
    return reads.filter(F.col("read_idx").between(start - 1, end - 1))


def split_long(reads: DataFrame, length: int) -> DataFrame:
    """Parts of at most ``length`` bases, each with the read's id."""
    at = F.explode(F.when(F.length("sequence") > 0, F.sequence(F.lit(0), F.length("sequence") - 1, F.lit(length))).otherwise(F.array(F.lit(0)))).alias("start")
    part = lambda c: F.substring(c, F.col("start") + 1, F.lit(length)).alias(c)
    return reads.select("*", at).select("read_idx", (F.col("start") / length).cast("int").alias("part"), "id", part("sequence"), part("quality"))

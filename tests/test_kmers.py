"""k-mer tables as numbers: the same rows as from texts, and no table of a whole input on the driver."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import sequence as S
from strandlake.operators import assembly, kmers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def sequences(spark):
    r = random.Random(3)
    text = "".join(r.choice("ACGT") for _ in range(400))
    rows = [(i, text[s : s + 40].replace("C", "c", 1)) for i in range(120) for s in [r.randrange(370)]]
    rows += [(200, None), (201, ""), (202, "AC"), (203, "ACGNéACGTTACGATTACNAC"), (204, text), (205, text[::-1])]
    return spark.createDataFrame(rows, "read_idx long, sequence string").repartition(3)


def as_texts(reads, k, step=1):
    rc = S.reverse_complement("kmer")
    rows = kmers.explode_kmers(reads.withColumn("sequence", F.upper("sequence")), k, step)
    return rows.select("read_idx", "pos", F.least("kmer", rc).alias("kmer"), (F.col("kmer") <= rc).alias("is_forward"))


@pytest.mark.parametrize("k, step", [(1, 1), (4, 3), (15, 2), (31, 1)])
def test_canonical_kmers_as_numbers(sequences, k, step, monkeypatch):
    monkeypatch.setattr(kmers, "SPAN", 64)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(kmers.canonical_kmers(sequences, k, step)) == rows(as_texts(sequences, k, step))


def test_hamming_of_arrays(spark):
    pairs = [("ACGT", "ACGA"), ("", "A"), (None, "A"), ("AC", None), ("ACGTT", "TCG"), ("AAAA", "TTTT")]
    count = lambda rows: [r.d for r in spark.createDataFrame(rows, "a string, b string").coalesce(1).select(S.hamming_within("a", "b", 3).alias("d")).collect()]
    assert count(pairs) == [1, 0, None, None, 1, None]
    assert count([("é%", "e%"), ("ACG", "TCG"), (None, "A")]) == [1, 1, None]


@pytest.mark.parametrize("k", [1, 4, 5, 15, 16, 17, 31])
def test_counts_as_numbers(sequences, k, monkeypatch):
    monkeypatch.setattr(kmers, "HELD", 50)
    got = {r["kmer"]: r["count"] for r in kmers.count_kmers(sequences, k).collect()}
    want = as_texts(sequences, k).groupBy("kmer").agg(F.count("*").alias("n")).collect()
    assert got == {r["kmer"]: r["n"] for r in want}


def test_counts_do_not_explode_in_the_planner(sequences):
    assert "Generate" not in plan(kmers.count_kmers(sequences, 15))


@pytest.mark.parametrize("k", [4, 5, 15])
def test_neighbours_as_numbers(sequences, k):
    counts = kmers.count_kmers(sequences, k).cache()
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(kmers.neighbours(counts, k)) == rows(kmers.neighbours(counts))


@pytest.mark.parametrize("k", [4, 5, 15])
def test_corrections_as_numbers(sequences, k):
    counts = kmers.count_kmers(sequences, k).cache()
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    for weak, strong in ((2, 3), (4, 2)):
        assert rows(assembly.correct_kmers(counts, weak, strong, k)) == rows(assembly.correct_kmers(counts, weak, strong))


def test_no_kmer_table_is_broadcast(spark, sf_dir):
    from strandlake.plans import registry

    for name in ("as04_neighbours", "as14_corrected_kmers"):
        assert "Broadcast" not in plan(registry.queries()[name](spark, sf_dir)), name

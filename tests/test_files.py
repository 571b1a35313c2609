import gzip

import pytest

from strandlake.plans.api import Options, compress, decompress, ultra_level
from strandlake.sources import archive, fastq

READS = [("@SIM:1:FC:1:1101:1000:1000 1:N:0:A", "ACGTACGTACGTACGTACGTACGTAAC", "I" * 27), ("@r2", "ACGTACGTACGTACGTACGTACGTACC", "H" * 27), ("@r3", "NNNN", "####"), ("@r4", "", ""), ("@r5", "A", "B"), ("@r6", "ACGTACGTACGTACGTACGTACGTAAG", "@" * 27)]


def text(reads):
    return "".join(f"{i}\n{s}\n+\n{q}\n" for i, s, q in reads)


@pytest.fixture()
def source(tmp_path):
    path = tmp_path / "in.fastq"
    path.write_text(text(READS * 20))
    return str(path)


def back(spark, path):
    return [(r.id, r.sequence, r.quality) for r in fastq.read_fastq(spark, path).orderBy("read_idx").collect()]


def test_scan(spark, source, tmp_path):
    assert back(spark, source) == READS * 20
    windows = tmp_path / "crlf.fastq"
    windows.write_bytes(text(READS).replace("\n", "\r\n").encode())
    assert back(spark, str(windows)) == READS


def test_scan_in_many_blocks(spark, tmp_path):
    path = tmp_path / "big.fastq"
    reads = [(f"@r{i}", "ACGT" * (i % 30), "IIII" * (i % 30)) for i in range(5000)]
    path.write_text(text(reads))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        assert back(spark, str(path)) == reads
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_gzip_by_first_bytes(spark, tmp_path):
    for name in ("a.fastq.gz", "b.fastq"):
        path = tmp_path / name
        path.write_bytes(gzip.compress(text(READS).encode()))
        assert back(spark, str(path)) == READS


@pytest.mark.parametrize("bad", ["@a\nAC\nBAD\nII\n", "@a\nACGT\n+\nIII\n", "@a\nAC\n+\n", "ACGT\nAC\n+\nII\n"])
def test_malformed(spark, tmp_path, bad):
    path = tmp_path / "bad.fastq"
    path.write_text(text(READS) + bad)
    with pytest.raises(Exception, match="record"):
        fastq.read_fastq(spark, str(path)).collect()


def test_empty_and_two_inputs(spark, tmp_path):
    path = tmp_path / "empty.fastq"
    path.write_text("")
    assert fastq.read_fastq(spark, str(path)).count() == 0
    with pytest.raises(ValueError):
        fastq.read_fastq(spark, ["a", "b"])


def test_fasta(spark, tmp_path):
    path = tmp_path / "x.fasta"
    path.write_text(">s1\nACGT\n>s2\nTGCA\n")
    rows = fastq.read_fastq(spark, str(path), fasta=True)
    assert [(r.id, r.sequence, r.quality) for r in rows.orderBy("read_idx").collect()] == [(">s1", "ACGT", None), (">s2", "TGCA", None)]
    compress(spark, str(path), str(tmp_path / "arc"), Options(fasta=True))
    decompress(spark, str(tmp_path / "arc"), str(tmp_path / "out"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))) == path.read_text()


@pytest.mark.parametrize("options", [
    Options(), Options(hints=True), Options(inline_delta=True), Options(canonical=True), Options(local_reorder=True, chunk=50), Options(ultra=1, order="center"), Options(ultra=3, order="similarity"),
    Options(reorder="local", chunk=30), Options(reorder="global"), Options(quality_codec="delta"), Options(quality_codec="model"),
], ids=str)
def test_lossless_round_trip(spark, source, tmp_path, options):
    compress(spark, source, str(tmp_path / "arc"), options)
    decompress(spark, str(tmp_path / "arc"), str(tmp_path / "out"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*"))) == text(READS * 20)


def test_lossy(spark, source, tmp_path):
    compress(spark, source, str(tmp_path / "arc"), Options(quality="binary"))
    rows = archive.read_archive(spark, str(tmp_path / "arc")).orderBy("read_idx").collect()
    assert rows[0].quality == chr(33 + 40) * 27 and rows[2].quality == chr(33 + 10) * 4
    compress(spark, source, str(tmp_path / "none"), Options(no_quality=True))
    assert archive.read_archive(spark, str(tmp_path / "none")).filter("quality is not null").count() == 0


def test_damaged_archives(spark, source, tmp_path):
    with pytest.raises(ValueError):
        archive.read_archive(spark, str(tmp_path / "nothing"))
    compress(spark, source, str(tmp_path / "arc"))
    meta = next((tmp_path / "arc" / "meta").glob("part-*.json"))
    good = meta.read_text()
    for old, new in (('"magic":"SL"', '"magic":"XX"'), ('"version":1', '"version":9'), ('"encoding_type":0', '"encoding_type":3'), ('"num_reads":120', '"num_reads":121')):
        for crc in meta.parent.glob(".*.crc"):
            crc.unlink()
        meta.write_text(good.replace(old, new))
        assert good != meta.read_text()
        with pytest.raises(ValueError):
            archive.read_archive(spark, str(tmp_path / "arc"))


@pytest.mark.parametrize("options", [Options(hints=True, canonical=True), Options(ultra=9), Options(quality="qvz"), Options(no_quality=True, quality_codec="delta"), Options(chunk=0), Options(reorder="both")], ids=str)
def test_exclusive_options(options):
    with pytest.raises(ValueError):
        options.check()


def test_levels():
    assert ultra_level(2, 1 << 40) == 1 and ultra_level(64, 1 << 40) == 5 and ultra_level(64, 4 << 30) == 2


def test_gzip_sink(spark, source, tmp_path):
    fastq.write_fastq(fastq.read_fastq(spark, source), str(tmp_path / "gz"), compress=True, level=9, single_file=True)
    assert gzip.decompress(next((tmp_path / "gz").glob("part-*.gz")).read_bytes()).decode() == text(READS * 20)


def test_scratch_tables_vanish(spark):
    from pathlib import Path

    from strandlake.session import discard, keep, scratch

    with scratch(spark):
        a, b = (keep(spark.range(5), "t") for _ in range(2))
        discard(a)
        assert b.count() == 5 and not Path(a._kept_path.removeprefix("file://")).exists() and Path(b._kept_path.removeprefix("file://")).exists()
    assert not Path(b._kept_path.removeprefix("file://")).exists()
    c = keep(spark.range(3), "t")
    assert c.count() == 3


def test_archive_files_follow_bytes_not_chunks(spark, tmp_path):
    """Many chunks behind a shuffle make no file for each chunk and task, and each chunk's reads stand together."""
    from pyspark.sql import functions as F

    from strandlake.sources import archive

    rows = [(i, f"@r{i}", "ACGTN"[i % 5 :] + "ACGTACGTTGCA"[: i % 12], chr(35 + i % 40) * ((5 - i % 5) + min(i % 12, 12))) for i in range(600)]
    reads = spark.createDataFrame(rows, "read_idx long, id string, sequence string, quality string").repartition(4)
    for n, options in enumerate(({"encoding": "ordered"}, {"quality_codec": "delta"}, {"quality_codec": "model"})):
        path = f"{tmp_path}/a{n}"
        archive.write_archive(reads, path, chunk=10, **options)
        assert len(spark.read.parquet(f"{path}/streams").inputFiles()) <= 8  # 60 chunks
        assert sorted(tuple(r) for r in archive.read_archive(spark, path).collect()) == rows
    files = spark.read.parquet(f"{tmp_path}/a0/streams").select("chunk_id", F.input_file_name().alias("file")).distinct().groupBy("chunk_id").agg(F.count("*").alias("n"))
    assert files.filter("n > 1").isEmpty()


def test_archive_of_odd_qualities(spark, tmp_path):
    from strandlake.sources import archive

    rows = [(0, "@a", "ACG", "II#"), (1, "@b", "A", None), (2, "@c", "", ""), (3, "@d", "ACGTACGT", "~!~!~!~!"), (4, "@e", "AC", "!~")]
    reads = spark.createDataFrame(rows, "read_idx long, id string, sequence string, quality string")
    for codec in ("plain", "delta", "model"):
        archive.write_archive(reads.filter("read_idx <> 1"), f"{tmp_path}/{codec}", quality_codec=codec)
        assert sorted(tuple(r) for r in archive.read_archive(spark, f"{tmp_path}/{codec}").collect()) == [r for r in rows if r[0] != 1]

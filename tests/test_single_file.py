"""One file is joined from parts that are sorted in parallel."""

import glob
import gzip

from strandlake.sources import fastq


def test_single_file_is_joined_from_ordered_parts(spark, tmp_path, monkeypatch):
    joined = []
    whole = fastq._join_parts
    monkeypatch.setattr(fastq, "_join_parts", lambda s, folder, path: (joined.extend(glob.glob(f"{folder}/part-*")), whole(s, folder, path)))
    monkeypatch.setattr(fastq, "as_text", lambda r, fasta: r.selectExpr("read_idx", "concat('line ', read_idx) as value"))
    rows = spark.range(3000).selectExpr("2999 - id as read_idx").repartition(6)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for compress in (False, True):
            fastq.write_fastq(rows, str(tmp_path / str(compress)), compress=compress, single_file=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(joined) > 2
    want = [f"line {i}" for i in range(3000)]
    plain, packed = (glob.glob(f"{tmp_path}/{c}/part-*") for c in (False, True))
    assert len(plain) == len(packed) == 1
    assert open(plain[0]).read().splitlines() == want and gzip.open(packed[0], "rt").read().splitlines() == want
    assert [r.value for r in spark.read.text(packed[0]).collect()] == want

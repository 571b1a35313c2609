from strandlake.streaming.ingest import stream_folder


def test_folder_stream(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for round_ in range(2):
        (source / f"{round_}.fastq").write_text("".join(f"@r{round_}.{k}\nACGT\n+\nIIII\n" for k in range(3)))
        query = stream_folder(spark, str(source), str(target), str(tmp_path / "check"))
        query.awaitTermination(60)
    rows = spark.read.parquet(str(target)).orderBy("chunk_id", "file", "record").collect()
    assert [r.id for r in rows] == [f"@r{a}.{k}" for a in range(2) for k in range(3)]
    assert len({r.chunk_id for r in rows}) == 2

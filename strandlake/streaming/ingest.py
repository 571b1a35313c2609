"""Read files that arrive in a folder as a stream: one chunk of the read table per micro-batch.

Row order across files is (batch, file, record); there is no event time, so no watermark.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def records(files: DataFrame) -> DataFrame:
    """(file, record, id, sequence, quality) of whole FASTQ files; wrong records raise."""

    def run(batches):
        for pdf in batches:
            for name, text in zip(pdf["file"], pdf["value"]):
                lines = text.split("\n")
                if lines and lines[-1] == "":
                    lines.pop()
                lines = [x.rstrip("\r") for x in lines]
                if len(lines) % 4:
                    raise ValueError(f"{name}: unexpected end of file")
                for at in range(0, len(lines), 40_000):
                    part = lines[at : at + 40_000]
                    ids, seqs, plus, quals = (part[k::4] for k in range(4))
                    for i, (p, s, q) in enumerate(zip(plus, seqs, quals)):
                        if not p.startswith("+") or len(s) != len(q):
                            raise ValueError(f"{name}: bad record {at // 4 + i}")
                    yield pd.DataFrame({"file": name, "record": range(at // 4, at // 4 + len(ids)), "id": ids, "sequence": seqs, "quality": quals})

    return files.mapInPandas(run, "file string, record long, id string, sequence string, quality string")


def stream_folder(spark: SparkSession, folder: str, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write each micro-batch's reads as Parquet under ``target``/chunk_id=<batch>; a batch that runs again
    replaces its own chunk."""
    files = spark.readStream.format("text").option("wholetext", "true").load(folder).select(F.col("_metadata.file_path").alias("file"), "value")

    def write(batch: DataFrame, number: int) -> None:
        records(batch).write.mode("overwrite").parquet(f"{target}/chunk_id={number}")

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

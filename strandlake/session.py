"""Session helpers: a local session for tests and benchmarks, and tables in the shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("strandlake").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; in local mode one of our own where none is configured."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="strandlake-core-")
        atexit.register(shutil.rmtree, _own[app], True)
    return "file://" + _own[app]


_scopes: list[list[str]] = []


def keep(df: DataFrame, tag: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage of iterative operators.

    The table stays until ``discard``, the end of the ``scratch`` block around it, or for good outside of one.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), spark.sparkContext.applicationId, f"{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_path = path
    if _scopes:
        _scopes[-1].append(path)
    return kept


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(kept: DataFrame) -> None:
    """Delete a table of ``keep`` that no later step reads."""
    _delete(kept.sparkSession, kept._kept_path)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that are kept within the block are deleted at its end, also after an error."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)

"""A bounded, reproducible sample of labelled documents for training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learnt from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def _known(labels: DataFrame, label: str, id_col: str) -> DataFrame:
    usable = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    return usable.groupBy(id_col).agg(F.max(label).cast("int").alias("y"))


def class_counts(labels: DataFrame, label: str, id_col: str = "doc_id") -> tuple[int, int]:
    """Usable labels 0 and 1."""
    found = {r.y: r["count"] for r in _known(labels, label, id_col).groupBy("y").count().collect()}
    return found.get(0, 0), found.get(1, 0)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text`` and ``y`` of at most ``per_class`` documents of each class, first in a seeded hash order.

    Null and held-out labels are left out; of several labels of a document the largest counts.
    """
    known = _known(labels, label, id_col)
    order = F.xxhash64(F.lit(11), F.col(id_col))
    picked = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(order, id_col).limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    picked = F.broadcast(picked.withColumnRenamed(id_col, "__id"))  # 2 * per_class rows at most
    return docs.join(picked, F.col(id_col) == F.col("__id")).select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"), "y")

"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from whole texts.  Trees are complete and flattened into arrays (feature, threshold
and value by node), so a batch walks a tree in ``depth`` vector steps.  Training uses at most
``TRAIN_PER_CLASS`` labelled documents of each class.

Null text counts as empty and is scored by its statistics like any other.  Without labels every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty
from .labelled import held_out, labelled_sample

TRAIN_PER_CLASS = 10_000
BINS = 32
_GROUPS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "line": [10], "blank": [32, 9], "high": range(128, 256),
    "bar": [124], "bang": [33], "hash": [35], "dollar": [36], "percent": [37], "and": [38], "star": [42], "comma": [44], "stop": [46],
    "slash": [47, 92], "angle": [60, 62], "at": [64], "other": [c for c in (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)) if c not in (33, 35, 36, 37, 38, 42, 44, 46, 47, 60, 62, 64, 92, 124)],
}
_GROUP_OF = np.full(256, len(_GROUPS))
for _i, _codes in enumerate(_GROUPS.values()):
    _GROUP_OF[list(_codes)] = _i


def statistics(piece) -> np.ndarray:
    """(documents, features) of a slice."""
    n, length = piece.n, np.diff(piece.offsets)
    owner = np.repeat(np.arange(n), length)
    width = len(_GROUPS) + 1
    share = np.bincount(owner * width + _GROUP_OF[piece.data], minlength=n * width).reshape(n, width) / np.maximum(length, 1)[:, None]
    by_byte = np.bincount(owner * 256 + piece.data, minlength=n * 256).reshape(n, 256) / np.maximum(length, 1)[:, None]
    entropy = -(by_byte * np.log2(np.maximum(by_byte, 1e-12))).sum(1)
    starts, ends, first = piece.words()
    words = np.diff(first)
    of = np.repeat(np.arange(n), words)
    size = ends - starts
    total = np.maximum(words, 1)
    hashes = piece.word_hashes(starts, ends, lower=True)

    def distinct(h, o):
        order = np.lexsort((h, o))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (o[order][1:] != o[order][:-1])
        return np.bincount(o[order][new], minlength=n)

    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    four = hashes[:-3] * np.uint64(3) + hashes[1:-2] * np.uint64(5) + hashes[2:-1] * np.uint64(7) + hashes[3:] * np.uint64(9) if len(hashes) > 3 else hashes[:0]
    inside = of[:-3] == of[3:] if len(hashes) > 3 else np.zeros(0, bool)
    four_of = of[:-3][inside] if len(hashes) > 3 else of[:0]
    mean_size = np.bincount(of, size, n) / total
    return np.column_stack([
        share, np.log1p(length), np.log1p(words), mean_size, np.sqrt(np.maximum(np.bincount(of, size.astype(float) ** 2, n) / total - mean_size**2, 0)),
        np.bincount(of, size <= 3, n) / total, np.bincount(of, size > 12, n) / total, distinct(hashes, of) / total,
        distinct(four[inside], four_of) / np.maximum(np.bincount(four_of, minlength=n), 1), np.bincount(of, same, n) / total, entropy,
        words / np.maximum(share[:, list(_GROUPS).index("line")] * length + 1, 1),
    ])


class Trees:
    """Additive logistic model of complete trees, flattened: node k of a tree has children 2k+1, 2k+2."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.base, self.feature, self.threshold, self.value = base, feature, threshold, value

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = (self.feature.shape[1] + 1).bit_length() - 1
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - len(f)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, l2: float = 2.0, least: float = 5.0) -> Trees:
    """Boost on quantile histograms with Newton leaf values."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    if not len(y) or len(np.unique(y)) < 2:
        base = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return Trees(base, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    rate_one = np.average(y, weights=weight)
    margin = np.full(len(y), np.log(rate_one / (1 - rate_one)))
    base, features, thresholds, values = margin[0], [], [], []
    columns = x.shape[1]
    cell = binned + np.arange(columns) * BINS
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (y - p), weight * p * (1 - p)
        node = np.zeros(len(y), np.int64)
        f, t = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            nodes, at = 1 << level, (1 << level) - 1
            key = ((node - at)[:, None] * (columns * BINS) + cell).ravel()
            gs, hs = (np.bincount(key, np.repeat(v, columns), nodes * columns * BINS).reshape(nodes, columns, BINS).cumsum(2) for v in (g, h))
            ga, ha = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + l2) + (ga - gs) ** 2 / (ha - hs + l2) - ga**2 / (ha + l2)
            gain[(hs < least) | (ha - hs < least)] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            for k in range(nodes):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    f[at + k], t[at + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), f[node]] > t[node])
        leaf = node - inner
        v = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + l2)
        margin += v[leaf]
        features.append(f)
        thresholds.append(t)
        values.append(v)
    return Trees(base, np.array(features), np.array(thresholds), np.array(values))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", per_class: int = TRAIN_PER_CLASS) -> Trees:
    def features(batches):
        for piece in slices(batches):
            flat = statistics(piece)
            yield pa.RecordBatch.from_arrays([piece.batch.column("id"), piece.batch.column("y"), pa.array(list(flat), pa.list_(pa.float64()))], names=["id", "y", "x"])

    rows = labelled_sample(docs, labels, label, per_class, id_col, text_col).mapInArrow(features, "id long, y int, x array<double>").toPandas().sort_values("id")
    if not len(rows):
        return fit(np.zeros((0, 1)), np.zeros(0), np.zeros(0))
    return fit(np.stack(rows["x"].to_numpy()), rows["y"].to_numpy(float), np.ones(len(rows)))


def score_quality(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", keep: float = 0.3) -> DataFrame:
    """``id_col``, held_out, score, predicted for each row."""

    def run(batches):
        for piece in slices(batches):
            score = model.score(statistics(piece))
            yield pa.RecordBatch.from_arrays([piece.batch.column("id"), piece.batch.column("held_out"), pa.array(score), pa.array((score >= keep).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)

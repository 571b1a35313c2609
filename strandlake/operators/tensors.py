"""Decompositions of a reads x positions x 5 tensor (one-hot base and scaled score).

Unfoldings are reduced to Gram matrices of positions x channels on the executors, whose size does not depend on
the number of reads.  CP and Tucker are fitted from the same matrix on all reads: a read's factors are linear in its
values, so that a fit is a map from a read to its approximation, whose errors are summed in a second pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 41.0
CHANNELS = "ACGT"


def tensor(pdf: pd.DataFrame, length: int) -> np.ndarray:
    out = np.zeros((len(pdf), length, 5))
    for i, (s, q) in enumerate(zip(pdf["sequence"], pdf["quality"])):
        for j, (b, c) in enumerate(zip(s[:length], q[:length])):
            k = CHANNELS.find(b)
            if k >= 0:
                out[i, j, k] = 1
            out[i, j, 4] = (ord(c) - 33) / SCALE
    return out


def gram(reads: DataFrame, length: int) -> np.ndarray:
    """Gram matrix of the read unfolding, (5 * length) squared, summed from one matrix per task."""

    def part(batches):
        total = np.zeros((5 * length, 5 * length))
        for pdf in batches:
            for k in range(0, len(pdf), 2000):
                x = tensor(pdf.iloc[k : k + 2000], length).reshape(-1, 5 * length)
                total += x.T @ x
        yield pd.DataFrame({"row": range(5 * length), "values": list(total)})

    rows = reads.select("sequence", "quality").mapInPandas(part, "row int, values array<double>")
    summed = rows.select("row", F.posexplode("values").alias("col", "v")).groupBy("row", "col").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((5 * length, 5 * length))
    out[summed["row"], summed["col"]] = summed["v"]
    return out


def svd_ranks(reads: DataFrame, length: int, shares=(0.9, 0.95, 0.99)) -> dict[float, int]:
    """Rank of the read unfolding that explains each share of its energy."""
    values = np.maximum(np.linalg.eigvalsh(gram(reads, length))[::-1], 0)
    part = np.cumsum(values) / values.sum()
    return {s: int(np.searchsorted(part, s) + 1) for s in shares}


def _unfold(t, mode):
    return np.moveaxis(t, mode, 0).reshape(t.shape[mode], -1)


def cp(t: np.ndarray, rank: int, steps: int = 50, seed: int = 42) -> np.ndarray:
    """Rank-``rank`` approximation by alternating least squares from a random start."""
    r = np.random.default_rng(seed)
    f = [r.random((n, rank)) for n in t.shape]
    for _ in range(steps):
        for m in range(3):
            a, b = (f[k] for k in range(3) if k != m)
            kr = np.einsum("ir,jr->ijr", a, b).reshape(-1, rank)
            f[m] = _unfold(t, m) @ kr @ np.linalg.pinv((a.T @ a) * (b.T @ b))
    return np.einsum("ir,jr,kr->ijk", *f)


def tucker(t: np.ndarray, ranks: tuple[int, int, int]) -> np.ndarray:
    """Truncated higher-order SVD."""
    u = [np.linalg.svd(_unfold(t, m), full_matrices=False)[0][:, :r] for m, r in enumerate(ranks)]
    core = np.einsum("ijk,ia,jb,kc->abc", t, *u)
    return np.einsum("abc,ia,jb,kc->ijk", core, *u)


def quality_of(t: np.ndarray, approx: np.ndarray) -> dict[str, float]:
    """Relative error, variance explained, base accuracy, score errors, and entropy of the residual bytes."""
    known = t[:, :, :4].sum(2) > 0
    d = (t[:, :, 4] - approx[:, :, 4]) * SCALE
    residual = np.round(d).astype(int)
    _, n = np.unique(residual, return_counts=True)
    p = n / n.sum()
    return {
        "relative_error": float(np.linalg.norm(t - approx) / np.linalg.norm(t)), "explained": float(1 - ((t - approx) ** 2).sum() / ((t - t.mean()) ** 2).sum()),
        "base_accuracy": float((t[:, :, :4].argmax(2) == approx[:, :, :4].argmax(2))[known].mean()), "score_mae": float(np.abs(d).mean()),
        "score_rmse": float(np.sqrt((d**2).mean())), "residual_bits": float(-(p * np.log2(p)).sum()),
    }


def cp_map(g: np.ndarray, reads: int, length: int, rank: int, steps: int = 50, seed: int = 42) -> np.ndarray:
    """What ``cp`` makes of a read, as a matrix on its (position, channel) values; from their Gram matrix over all reads."""
    r = np.random.default_rng(seed)
    r.bit_generator.advance(reads * rank)  # the start of the read factor, which is not used
    b, c = r.random((length, rank)), r.random((5, rank))
    for _ in range(steps):
        w = np.einsum("jr,kr->jkr", b, c).reshape(-1, rank) @ np.linalg.pinv((b.T @ b) * (c.T @ c))
        m, own = (w.T @ g).reshape(rank, length, 5), w.T @ g @ w
        b = np.einsum("rjk,kr->jr", m, c) @ np.linalg.pinv(own * (c.T @ c))
        c = np.einsum("rjk,jr->kr", m, b) @ np.linalg.pinv(own * (b.T @ b))
    return w @ np.einsum("jr,kr->jkr", b, c).reshape(-1, rank).T


def tucker_map(g: np.ndarray, length: int, ranks: tuple[int, int, int]) -> np.ndarray:
    """The same for ``tucker``."""
    cube = g.reshape(length, 5, length, 5)
    u = [np.linalg.eigh(m)[1][:, ::-1][:, :n] for m, n in zip((g, np.einsum("jkmk->jm", cube), np.einsum("jkjm->km", cube)), ranks)]
    v, a, b = (x @ x.T for x in u)
    return v @ np.kron(a, b)


def qualities(reads: DataFrame, length: int, maps: dict[str, np.ndarray]) -> list[dict]:
    """``quality_of`` each map over all reads, from sums of each task."""

    def part(batches):
        sums: dict = {}

        def add(method, key, value):
            sums[method, key] = sums.get((method, key), 0.0) + float(value)

        for pdf in batches:
            for k in range(0, len(pdf), 2000):
                t = tensor(pdf.iloc[k : k + 2000], length)
                known = t[:, :, :4].sum(2) > 0
                for key, value in (("n", t.size), ("sum", t.sum()), ("squares", (t**2).sum()), ("known", known.sum())):
                    add("", key, value)
                for method, m in maps.items():
                    approx = (t.reshape(len(t), -1) @ m).reshape(t.shape)
                    d = (t[:, :, 4] - approx[:, :, 4]) * SCALE
                    right = (t[:, :, :4].argmax(2) == approx[:, :, :4].argmax(2))[known].sum()
                    for key, value in (("error", ((t - approx) ** 2).sum()), ("right", right), ("absolute", np.abs(d).sum()), ("squares", (d**2).sum())):
                        add(method, key, value)
                    for v, n in zip(*np.unique(np.round(d).astype(int), return_counts=True)):
                        add(method, f"residual {v}", n)
        yield pd.DataFrame([(m, k, v) for (m, k), v in sums.items()], columns=["method", "key", "value"])

    rows = reads.select("sequence", "quality").mapInPandas(part, "method string, key string, value double")
    got = {(r.method, r.key): r.value for r in rows.groupBy("method", "key").agg(F.sum("value").alias("value")).collect()}
    n, total, squares, known = (got["", k] for k in ("n", "sum", "squares", "known"))
    scores = n / 5
    out = []
    for m in maps:
        p = np.array([v for (method, key), v in got.items() if method == m and key.startswith("residual")]) / scores
        out.append({
            "method": m, "relative_error": float(np.sqrt(got[m, "error"] / squares)), "explained": 1 - got[m, "error"] / (squares - total**2 / n), "base_accuracy": got[m, "right"] / known,
            "score_mae": got[m, "absolute"] / scores, "score_rmse": float(np.sqrt(got[m, "squares"] / scores)), "residual_bits": float(-(p * np.log2(p)).sum()),
        })
    return out


def decompositions(reads: DataFrame, length: int, ranks=(5, 10, 20, 50)) -> pd.DataFrame:
    """Quality of CP at several ranks and of Tucker, over all reads."""
    g, n = gram(reads, length), reads.count()
    maps = {f"cp{r}": cp_map(g, n, length, r) for r in ranks}
    maps["tucker"] = tucker_map(g, length, (min(50, n), min(20, length), 5))
    return pd.DataFrame(qualities(reads, length, maps))

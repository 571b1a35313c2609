"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters the network as three parts: an embedding of the word (hashed to ``WORD_BITS``), the mean
embedding of its character ``GRAM``-grams (hashed to ``CHAR_BITS``, with marks at both ends of the word), and
the log-odds of the word and of its most telling gram.  Both embeddings are learnt with the network.  A document's
words are cut into overlapping windows, every window is scored, and the strongest window is the document's.

Training reads at most ``TRAIN_PER_CLASS`` labelled documents of each class and ``TRAIN_BYTES`` of
text, of which each class has half and what the other leaves; documents that do not fit are passed over,
and a class of which none fits takes part with its shortest.  It runs in one executor task, and only the
weights come to the driver.  Log-odds that the network trains on come from the other half of the sample,
so that it learns how far to trust them.

Null and empty texts have one window without words and get the network's score for it.  Equal texts get equal
scores but for the rounding of 32-bit sums; rows that repeat an id are scored one by one.  Rows with a null id are scored and not held out.  Without
labels of both classes every score is that of an untrained prior, below 0.5.  An empty table gives an empty result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Slice, _splitmix, materialize, slices, text_or_empty
from .labelled import class_counts, held_out, labelled_sample

TRAIN_PER_CLASS = 2000
TRAIN_BYTES = 24 << 20
WINDOW, STRIDE = 64, 48
WORD_BITS, CHAR_BITS = 16, 16
WORD_DIM, CHAR_DIM, ODDS = 6, 6, 2
GRAM = 4
HIDDEN = 8
PRIOR_DOCS = 8
EMBED_RATE = 0.05
STEPS = 600
INPUTS = WORD_DIM + CHAR_DIM + ODDS
EMBEDDED = (("ew", 0, WORD_DIM), ("ec", WORD_DIM, WORD_DIM + CHAR_DIM))


def _fold(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def _trim(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word bounds without one ASCII punctuation mark at either end, if something is left."""
    mark = np.ones(256, bool)
    mark[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
    cut = (ends - starts > 1) & mark[data[ends - 1]]
    ends = ends - cut
    return starts + ((ends - starts > 1) & mark[data[starts]]), ends


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] of them, for every i in turn."""
    cuts = np.cumsum(counts) - counts
    return np.repeat(starts - cuts, counts) + np.arange(int(counts.sum()))


class Words:
    """The distinct words of a slice, the hashed pieces of each, and which of them stands where."""

    def __init__(self, piece: Slice):
        starts, ends, self.first = piece.words()
        self.n = piece.n
        data = _fold(piece.data)
        if len(starts):
            starts, ends = _trim(piece.data, starts, ends)
        hashes, at, self.of = np.unique(piece.word_hashes(starts, ends, lower=True), return_index=True, return_inverse=True)
        starts, ends = starts[at], ends[at]
        self.words = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        # a space at either end: a word of n bytes has n + 2 - GRAM + 1 grams, one at least
        self.counts = np.maximum(ends - starts + 3 - GRAM, 1)
        self.cuts = np.cumsum(self.counts) - self.counts
        place = spread(starts - 1, self.counts)
        low, high = np.repeat(starts, self.counts), np.repeat(ends, self.counts)
        mixed = np.zeros(len(place), np.uint64)
        for k in range(GRAM):
            inside = (place + k >= low) & (place + k < high)
            byte = data[np.where(inside, place + k, low)] if len(place) else np.zeros(0, np.uint8)
            mixed |= np.where(inside, byte, 32).astype(np.uint64) << np.uint64(8 * k)
        self.grams = (_splitmix(mixed) >> np.uint64(64 - CHAR_BITS)).astype(np.int64)

    def mean(self, values: np.ndarray) -> np.ndarray:
        """Mean over each word's grams of one row per gram."""
        if not len(self.cuts):
            return np.zeros((0, *values.shape[1:]), np.float32)
        return np.add.reduceat(values, self.cuts) / self.counts.reshape(-1, *[1] * (values.ndim - 1))


class LogOdds:
    """Class log-odds of word and gram buckets, over the class prior and shrunk to it where few documents
    hold the bucket."""

    def __init__(self, counts):
        self.tables = []
        for (a, b), (n1, n0) in counts:
            prior = (n1 + 1) / (n1 + n0 + 2)
            p = (a + PRIOR_DOCS * prior) / (a + b + PRIOR_DOCS)
            self.tables.append((np.log(p / (1 - p)) - np.log(prior / (1 - prior))).astype(np.float32))

    @staticmethod
    def count(parsed: list[Words], labels: list[np.ndarray], use: list[np.ndarray]):
        """Documents of each class that hold a bucket, among those with ``use``."""
        out = []
        for bits, pieces in ((WORD_BITS, False), (CHAR_BITS, True)):
            held, totals, size = np.zeros((2, 1 << bits)), np.zeros(2), 1 << bits
            for p, y, u in zip(parsed, labels, use):
                of = np.repeat(np.arange(p.n), np.diff(p.first))
                pair = np.unique(of * max(1, len(p.words)) + p.of)  # documents by distinct word
                of, word = pair // max(1, len(p.words)), pair % max(1, len(p.words))
                bucket = p.words[word] if len(word) else word
                if pieces and len(word):
                    of, bucket = np.repeat(of, p.counts[word]), p.grams[spread(p.cuts[word], p.counts[word])]
                pair = np.unique(of * size + bucket)
                of, bucket = pair // size, pair % size
                for c in (0, 1):
                    held[c] += np.bincount(bucket[u[of] & (y[of] == c)], minlength=size)
                    totals[c] += (u & (y == c)).sum()
            out.append(((held[1], held[0]), (totals[1], totals[0])))
        return out

    def features(self, p: Words) -> np.ndarray:
        """(distinct words, ODDS): of the word, and of its most telling gram."""
        x = np.zeros((len(p.words), ODDS), np.float32)
        if len(p.words):
            x[:, 0] = self.tables[0][p.words] / 4
            x[:, 1] = np.maximum.reduceat(self.tables[1][p.grams], p.cuts) / 4
        return x


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, words and document of every window; one empty window where there are no words."""
    n = np.diff(first)
    count = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return first[:-1][doc] + k * STRIDE, np.clip(n[doc] - k * STRIDE, 0, WINDOW), doc


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    """Weights by name.  ``x`` holds one row of inputs per distinct word, and ``tokens`` (windows, steps) tells
    which of them stands where."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        h, k = HIDDEN, HIDDEN
        f = lambda *s: (r.normal(0, 1, s) / np.sqrt(s[0])).astype(np.float32)
        self.w = {"ew": np.zeros((1 << WORD_BITS, WORD_DIM), np.float32), "ec": np.zeros((1 << CHAR_BITS, CHAR_DIM), np.float32)}  # unknown words say nothing
        for d in "fb":
            self.w |= {f"{d}x": f(INPUTS, 3 * h), f"{d}u": f(h, 2 * h), f"{d}c": f(h, h), f"{d}b": np.zeros(3 * h, np.float32)}
        self.w |= {"a": f(2 * h, k), "ab": np.zeros(k, np.float32), "v": f(k), "o": f(2 * h), "ob": np.full(1, -2, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, p: Words, odds: np.ndarray) -> np.ndarray:
        return np.concatenate([self.w["ew"][p.words], p.mean(self.w["ec"][p.grams]), odds], 1).astype(self.w["ew"].dtype)

    def logits(self, x: np.ndarray, tokens: np.ndarray, length: np.ndarray, keep: list | None = None) -> np.ndarray:
        w, n = self.w, len(tokens)
        steps = int(length.max(initial=0))
        if not steps:
            return np.full(n, w["ob"][0])
        at = np.ascontiguousarray(tokens[:, :steps].T)
        mask = (np.arange(steps) < length[:, None]).astype(x.dtype)
        hidden = np.zeros((steps, n, 2 * HIDDEN), x.dtype)
        tape = {}
        for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            g = x @ w[f"{d}x"] + w[f"{d}b"]
            h = np.zeros((n, HIDDEN), x.dtype)
            side = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, 2 * HIDDEN)
            tape[d] = []
            for t in order:
                gt, m = g[at[t]], mask[:, t : t + 1]
                zr = _sigmoid(gt[:, : 2 * HIDDEN] + h @ w[f"{d}u"])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(gt[:, 2 * HIDDEN :] + (r * h) @ w[f"{d}c"])
                new = h + m * z * (c - h)
                if keep is not None:
                    tape[d].append((t, h, z, r, c, m))
                h = hidden[t, :, side] = new
        act = np.tanh(hidden @ w["a"] + w["ab"])
        score = np.where(mask.T > 0, act @ w["v"], -1e9)
        top = score.max(0)
        alpha = np.exp(score - top) * mask.T
        alpha /= np.maximum(alpha.sum(0), 1e-9)
        pooled = (alpha[:, :, None] * hidden).sum(0)
        if keep is not None:
            keep += [at, hidden, tape, act, alpha, pooled]
        return pooled @ w["o"] + w["ob"]

    def gradients(self, x, tokens, length, dlogit) -> dict:
        """Of a loss whose derivative by the logits is ``dlogit(logits)``: by weight name, and by ``x`` under "x"."""
        keep: list = []
        out = self.logits(x, tokens, length, keep)
        dl = dlogit(out).astype(x.dtype)
        w = self.w
        if not keep:
            return {"ob": dl.sum(keepdims=True)}
        at, hidden, tape, act, alpha, pooled = keep
        g = {"o": pooled.T @ dl, "ob": dl.sum(keepdims=True)}
        dp = dl[:, None] * w["o"]
        dh = alpha[:, :, None] * dp
        da = (hidden * dp).sum(2)
        ds = alpha * (da - (alpha * da).sum(0))
        g["v"] = (act * ds[:, :, None]).sum((0, 1))
        dact = ds[:, :, None] * w["v"] * (1 - act**2)
        g["a"] = np.tensordot(hidden, dact, ((0, 1), (0, 1)))
        g["ab"] = dact.sum((0, 1))
        dh += dact @ w["a"].T
        g["x"] = np.zeros_like(x)
        order = np.argsort(at, axis=None, kind="stable")
        spots = at.ravel()[order]
        starts = np.flatnonzero(np.append(True, spots[1:] != spots[:-1]))
        for d in "fb":
            side = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, 2 * HIDDEN)
            gu, gc = np.zeros_like(w[d + "u"]), np.zeros_like(w[d + "c"])
            pre = np.zeros((*at.shape, 3 * HIDDEN), x.dtype)
            carry = np.zeros((at.shape[1], HIDDEN), x.dtype)
            for t, h, z, r, c, m in reversed(tape[d]):
                total = carry + dh[t, :, side]
                dn = total * m
                dc = dn * z * (1 - c**2)
                drh = dc @ w[f"{d}c"].T
                dzr = np.concatenate([dn * (c - h) * z * (1 - z), drh * h * r * (1 - r)], 1)
                carry = total - dn * z + drh * r + dzr @ w[f"{d}u"].T
                pre[t] = np.concatenate([dzr, dc], 1)
                gu += h.T @ dzr
                gc += (r * h).T @ dc
            # tokens of one word share its inputs
            by_word = np.zeros((len(x), 3 * HIDDEN), x.dtype)
            by_word[spots[starts]] = np.add.reduceat(pre.reshape(-1, 3 * HIDDEN)[order], starts)
            g |= {f"{d}x": x.T @ by_word, f"{d}b": by_word.sum(0), f"{d}u": gu, f"{d}c": gc}
            g["x"] += by_word @ w[f"{d}x"].T
        return g

    def document_logits(self, x, of, first) -> np.ndarray:
        """Logit of each document's strongest window, over all windows, in blocks."""
        start, length, doc = windows(first)
        best = np.full(len(first) - 1, -np.inf)
        order = np.argsort(-length, kind="stable")  # windows of one length together
        for k in range(0, len(start), 1024):
            part = order[k : k + 1024]
            np.maximum.at(best, doc[part], self.logits(x, token_rows(of, start[part]), length[part]))
        return best


def token_rows(of: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(windows, WINDOW) distinct words; what lies behind the end is masked by the length."""
    at = start[:, None] + np.arange(WINDOW)
    return of[np.minimum(at, len(of) - 1)] if len(of) else np.zeros(at.shape, np.int64)


class Model:
    def __init__(self, odds: LogOdds | None, network: Network):
        self.odds, self.network = odds, network

    def score(self, piece: Slice) -> np.ndarray:
        if self.odds is None:
            return np.full(piece.n, 0.1)
        p = Words(piece)
        logit = self.network.document_logits(self.network.inputs(p, self.odds.features(p)), p.of, p.first)
        return _sigmoid(np.clip(logit * self.network.scale + self.network.shift, -30, 30).astype(np.float64))


def sketch(p: Words) -> np.ndarray:
    """One min-hash of each document's word pairs: near copies mostly agree on it."""
    owner = np.repeat(np.arange(p.n), np.diff(p.first))
    word = p.words[p.of] if len(p.of) else p.of
    mixed = (word * 40503 + np.roll(word, -1) * 30011) * 2654435761 % (1 << 40)
    low = np.full(p.n, 1 << 41)
    np.minimum.at(low, owner, mixed)
    return low


class Adam:
    """Dense steps for the network, and for embeddings steps of the rows that a batch touches."""

    def __init__(self, w: dict):
        self.w, self.moments = w, {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}

    def step(self, n: int, rate: float, name: str, grad: np.ndarray, rows=slice(None)):
        m, v = (x[rows] for x in self.moments[name])
        m, v = m + 0.1 * (grad - m), v + 0.01 * (grad**2 - v)
        self.moments[name][0][rows], self.moments[name][1][rows] = m, v
        self.w[name][rows] -= (rate * (m / (1 - 0.9**n)) / (np.sqrt(v / (1 - 0.99**n)) + 1e-7)).astype(np.float32)


def add_rows(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices and the sums of their rows."""
    order = np.argsort(index, kind="stable")
    index = index[order]
    starts = np.flatnonzero(np.append(True, index[1:] != index[:-1]))
    return index[starts], np.add.reduceat(values[order], starts)


def fit(pieces: list[Slice], labels: list[np.ndarray], counts: tuple[int, int] = (1, 1), steps: int = STEPS, batch: int = 128, seed: int = 5) -> Model:
    network = Network(seed)
    every = np.concatenate(labels) if labels else np.zeros(0)
    if len(np.unique(every)) < 2:
        return Model(None, network)
    parsed = [Words(p) for p in pieces]
    # of near copies one takes part, so that no half knows the other's documents
    marks = np.concatenate([sketch(p) for p in parsed])
    single = np.zeros(len(marks), bool)
    single[np.unique(marks, return_index=True)[1]] = True
    use = np.split(single, np.cumsum([p.n for p in parsed])[:-1])
    half = [np.arange(p.n) % 2 == 0 for p in parsed]
    other = [LogOdds(LogOdds.count(parsed, labels, [(h == side) & u for h, u in zip(half, use)])) for side in (False, True)]

    # inputs of a slice come in two copies, with the log-odds of either half; a document takes those of the other one
    r = np.random.default_rng(seed)
    tokens, lengths, targets, base = [], [], [], 0
    pool = []
    for p, y, h, u in zip(parsed, labels, half, use):
        odds = [o.features(p) for o in other]
        size = len(p.words)
        start, length, doc = windows(p.first)
        x = np.where(np.repeat(h, np.diff(p.first))[:, None], odds[0][p.of], odds[1][p.of]) if size else np.zeros((0, ODDS))
        sums = np.concatenate([[0], np.cumsum(np.maximum(x.max(1, initial=0), 0) ** 2)])
        strength = sums[start + length] - sums[start]
        order = np.lexsort((r.random(len(doc)), -strength, doc))
        rank = np.arange(len(doc)) - np.searchsorted(doc[order], doc[order])
        # a toxic document's strongest window; of a clean one the strongest and two by chance
        chosen = order[u[doc[order]] & ((rank == 0) | (y[doc[order]] == 0) & (r.random(len(doc)) * (1 + np.bincount(doc, minlength=p.n))[doc[order]] < 2))]
        tokens.append(token_rows(p.of, start[chosen]) + np.where(h[doc[chosen]], base, base + size)[:, None])
        lengths.append(length[chosen])
        targets.append(y[doc[chosen]])
        pool += [(p, o) for o in odds]
        base += 2 * size
    tokens, length, target = np.concatenate(tokens), np.concatenate(lengths), np.concatenate(targets).astype(np.float32)
    weight = np.where(target == 1, 0.5 / max(target.mean(), 1e-6), 0.5 / max(1 - target.mean(), 1e-6)).astype(np.float32)
    word = np.concatenate([p.words for p, _ in pool])
    odds = np.concatenate([o for _, o in pool])
    counts_of = np.concatenate([p.counts for p, _ in pool])
    grams = np.concatenate([p.grams for p, _ in pool])
    cuts_of = np.cumsum(counts_of) - counts_of
    adam = Adam(network.w)
    shuffled = np.concatenate([r.permutation(len(length)) for _ in range(-(-steps * batch // len(length)))])
    for step in range(1, steps + 1):
        pick = shuffled[(step - 1) * batch : step * batch]
        here, at = np.unique(np.where(np.arange(WINDOW) < length[pick][:, None], tokens[pick], tokens[pick][:, :1]), return_inverse=True)
        if not len(word):
            here, at = np.zeros(0, np.int64), at * 0
        n, part = counts_of[here], spread(cuts_of[here], counts_of[here])
        first = np.cumsum(n) - n
        mean = np.add.reduceat(network.w["ec"][grams[part]], first) / n[:, None] if len(here) else np.zeros((0, CHAR_DIM))
        x = np.concatenate([network.w["ew"][word[here]], mean, odds[here]], 1).astype(np.float32)
        g = network.gradients(x, at.reshape(len(pick), WINDOW), length[pick], lambda out, pick=pick: (_sigmoid(out) - target[pick]) * weight[pick] / len(pick))
        rate = 0.03 * (1 - step / (steps + 1))
        dx = g.pop("x", None)
        for name, grad in g.items():
            adam.step(step, rate, name, grad)
        if dx is not None:
            for name, index, values in (("ew", word[here], dx[:, :WORD_DIM]), ("ec", grams[part], np.repeat(dx[:, WORD_DIM : WORD_DIM + CHAR_DIM] / n[:, None], n, axis=0))):
                adam.step(step, rate * EMBED_RATE, name, *add_rows(index, values)[::-1])
    # the maximum over a document's windows is calibrated on all windows of the sample, at the classes' true rates
    logit = []
    for p, h in zip(parsed, half):
        by_half = [network.document_logits(network.inputs(p, o.features(p)), p.of, p.first) for o in other]
        logit.append(np.where(h, by_half[0], by_half[1]))
    logit = np.concatenate(logit)[single]
    every = every[single]
    rates = np.array(counts) / max(1, sum(counts)) / np.maximum([(every == 0).mean(), (every == 1).mean()], 1e-6)
    for _ in range(300):
        e = (_sigmoid(logit * network.scale + network.shift) - every) * rates[every.astype(int)]
        network.scale = max(0.1, network.scale - 0.2 * (e * logit).mean())
        network.shift -= 0.2 * e.mean()
    return Model(LogOdds(LogOdds.count(parsed, labels, use)), network)


def within_budget(sizes: pd.DataFrame, most_bytes: int) -> list[int]:
    """Ids of both classes, in the order of ``k``, whose ``b`` bytes fit; the smaller class chooses first."""
    taken, left = [], most_bytes
    parts = sorted((part.sort_values(["k", "id"]) for _, part in sizes.groupby("y")), key=lambda part: part["b"].sum())
    for nth, part in enumerate(parts):
        room = left // (len(parts) - nth)
        ids = []
        for i, b in zip(part["id"].tolist(), part["b"].tolist()):
            if b <= room:
                ids.append(i)
                room -= b
                left -= b
        # both classes must be there, so a class without any that fits gives its shortest
        taken += ids or [part.sort_values(["b", "k", "id"])["id"].tolist()[0]]
    return taken


def _fit_task(counts: tuple[int, int], steps: int):
    """All rows of the sample in one task; one row with the fitted model."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            rows = pa.Table.from_batches(held).to_pandas().sort_values(["id", "text"], ignore_index=True)
            pieces = list(slices(pa.Table.from_pandas(rows, preserve_index=False).to_batches()))
            model = fit(pieces, [p.column("y").astype(np.int64) for p in pieces], counts, steps)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", per_class: int = TRAIN_PER_CLASS, most_bytes: int = TRAIN_BYTES, steps: int = STEPS) -> Model:
    """Fitted in one executor task on ``most_bytes`` of text; the driver sees sizes by id and the weights."""
    sample = materialize(labelled_sample(docs, labels, label, per_class, id_col, text_col), "sample")
    sizes = sample.groupBy("id", "y").agg(F.sum(F.octet_length("text")).alias("b")).withColumn("k", F.xxhash64(F.lit(13), "id")).toPandas()
    taken = within_budget(sizes, most_bytes)  # 2 * per_class ids at most
    if not taken:
        return Model(None, Network())
    rows = sample.filter(F.col("id").isin(taken)).select("id", "text", "y").repartition(1)
    fitted = rows.mapInArrow(_fit_task(class_counts(labels, label, id_col), steps), "model binary").collect()
    return pickle.loads(fitted[0].model) if fitted else Model(None, Network())


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``id_col``, held_out, score, predicted for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two embeddings, two tables of log-odds and the network: about a MB

    def run(batches):
        own = sent.value
        for piece in slices(batches):
            score = own.score(piece)
            yield pa.RecordBatch.from_arrays([piece.batch.column("id"), piece.batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = sent.value
        for piece in slices(batches, text_col):
            yield piece.batch.filter(pa.array(own.score(piece) < threshold))

    return docs.mapInArrow(run, docs.schema)

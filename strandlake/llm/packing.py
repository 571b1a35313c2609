"""Hierarchical packing of tokenised documents into windows of several lengths.

Documents are tokenised, cut into full windows of the longest tier, and their remainders routed to
the smallest tier that holds them.  Each tier is packed from its longest pieces down; a window's gap
takes the longest shorter piece that fits, and what is then left is filled by cutting a shorter
document.  Only the last window of a group can stay open; it is cut into power-of-two windows, so
no token of padding is needed.  Windows of a tier are dealt to step groups of equal tokens in snake order.

Each task packs what it has read, in groups of bounded size, so nothing is shuffled.  Null text is
empty and gives the end id alone.  Rows that repeat an id are packed one by one.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

TIERS = (4096, 2048, 1024, 512, 256)
END_ID = 2
GROUP_TOKENS = 1 << 21
STEP_TOKENS = 1 << 16
CACHE_WORDS = 700_000
_SCHEMA = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokens:
    """Ids of whitespace-separated words, kept per worker.

    The tokenizer drops white space, lower-cases, and treats letter runs apart from other characters,
    so the ids of a text are those of its words one after another, and a letter or digit before a
    single comma or full stop at a word's end may be parted from it.
    """

    #: a comma or full stop at a word's end that does not follow an ASCII letter, digit, or Latin-1 letter
    _odd = re.compile(rb"[,.](?<![a-z0-9][,.])(?<!\xc3[\x80-\x96\x98-\xb6\xb8-\xbf][,.])\s")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.lengths, self.flat = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]

    def split(self, text: bytes) -> list[bytes]:
        text = text.lower()  # ASCII letters only
        if not self._odd.search(text):
            for end in (b", ", b". ", b".\n", b",\n"):
                text = text.replace(end, b" " + end)
        return text.split()

    def _add(self, words: set[bytes]) -> None:
        letters, other = [], []
        for w in words:
            (letters if w.isalpha() or w[0] > 64 and w.decode().isalpha() else other).append(w)
        for k in range(0, len(letters), 256):
            part = letters[k : k + 256]
            found = self.tokenizer.encode(b" ".join(part).decode(), add_special_tokens=False)
            counts = np.bincount(np.array(found.word_ids, np.int64), minlength=len(part))
            if len(counts) == len(part) and counts.min() > 0:
                self._keep(part, counts, found.ids)
            else:
                other += part
        for k in range(0, len(other), 256):
            part = other[k : k + 256]
            found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)]
            self._keep(part, np.array([len(x) for x in found], np.int64), [i for x in found for i in x])

    def _keep(self, words: list[bytes], counts: np.ndarray, ids: list[int]) -> None:
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words))))
        self.lengths.append(counts)
        self.flat.append(np.array(ids, np.uint32))

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the number of ids of each word."""
        missing = set(words).difference(self.at)
        if missing:
            if len(self.at) + len(missing) > CACHE_WORDS:
                self.clear()
                missing = set(words)
            self._add(missing)
        if len(self.flat) > 1:
            self.lengths, self.flat = [np.concatenate(self.lengths)], [np.concatenate(self.flat)]
        lengths, flat = self.lengths[0], self.flat[0]
        firsts = np.cumsum(lengths) - lengths
        which = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        sizes = lengths[which]
        ends = np.cumsum(sizes)
        if not len(ends):
            return np.zeros(0, np.uint32), sizes
        where = np.arange(ends[-1]) + np.repeat(firsts[which] - (ends - sizes), sizes)
        return flat[where], sizes


_words: dict[str, WordTokens] = {}


def tokenise(piece, path: str) -> list[np.ndarray]:
    """Ids of each document of a slice, with the end id."""
    if path not in _words:
        _words[path] = WordTokens(path)
    split = [_words[path].split(piece.bytes(i)) for i in range(piece.n)]
    ids, sizes = _words[path].encode([w for ws in split for w in ws])
    per_word = np.concatenate([[0], np.cumsum(sizes)])
    cuts = per_word[np.concatenate([[0], np.cumsum([len(ws) for ws in split])])]
    end = np.array([END_ID], np.uint32)
    return [np.concatenate([ids[cuts[i] : cuts[i + 1]], end]) for i in range(piece.n)]


def pack_group(lengths: list[int], tiers=TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows (size, [(document, start, length), ...]) that hold every token of the documents once."""
    windows, rest = [], []
    top = tiers[0]
    for d, n in enumerate(lengths):
        full = n // top
        windows += [(top, [(d, k * top, top)]) for k in range(full)]
        if n % top:
            rest.append((n % top, d, full * top))
    rest.sort()
    for i, tier in enumerate(tiers):
        least = tiers[i + 1] if i + 1 < len(tiers) else 0
        while rest and rest[-1][0] > least:
            n, d, start = rest.pop()
            pieces, gap = [(d, start, n)], tier - n
            while gap and rest:
                k = bisect_right(rest, (gap, 1 << 62, 0)) - 1
                n, d, start = rest.pop(max(k, 0))
                take = min(n, gap)
                pieces.append((d, start, take))
                if take < n:
                    insort(rest, (n - take, d, start + take))
                gap -= take
            if not gap:
                windows.append((tier, pieces))
            else:
                windows += _powers_of_two(pieces)
    return windows


def _powers_of_two(pieces):
    """Cut the pieces of an open window into full power-of-two windows."""
    left, out, queue = sum(p[2] for p in pieces), [], list(pieces)
    while left:
        size = 1 << (left.bit_length() - 1)
        window, need = [], size
        while need:
            d, start, n = queue[0]
            take = min(n, need)
            window.append((d, start, take))
            queue[0] = (d, start + take, n - take)
            if take == n:
                queue.pop(0)
            need -= take
        out.append((size, window))
        left -= size
    return out


def deal_steps(windows) -> list[int]:
    """Step group of each window: equal tokens within a tier, long documents spread in snake order."""
    step, base = [0] * len(windows), 0
    for tier in sorted({w[0] for w in windows}, reverse=True):
        own = [i for i, w in enumerate(windows) if w[0] == tier]
        groups = -(-len(own) * tier // STEP_TOKENS)
        own.sort(key=lambda i: -sum(p[2] ** 2 for p in windows[i][1]))
        for rank, i in enumerate(own):
            turn, at = divmod(rank, groups)
            step[i] = base + (at if turn % 2 == 0 else groups - 1 - at)
        base += groups
    return step


def _pack(path: str, tiers):
    def run(batches):
        base = TaskContext.get().partitionId() << 36
        state = {"sequence": base, "step": base}
        ids, docs, held = [], [], 0

        def flush():
            windows = pack_group([len(d) for d in docs], tiers)
            steps = deal_steps(windows)
            out = [[] for _ in range(9)]
            for k, (tier, pieces) in enumerate(windows):
                offset = 0
                for d, start, n in pieces:
                    row = (ids[d], start, n, zlib.crc32(docs[d][start : start + n].tobytes()), len(docs[d]), state["sequence"] + k, offset, tier, state["step"] + steps[k])
                    for to, v in zip(out, row):
                        to.append(v)
                    offset += n
            state["sequence"] += len(windows)
            state["step"] += max(steps, default=-1) + 1
            ids.clear()
            docs.clear()
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if n == "tier" else pa.int64()) for v, n in zip(out, names)], names=names)

        for piece in slices(batches):
            found = tokenise(piece, path)
            for i, d in zip(piece.batch.column("id").to_pylist(), found):
                ids.append(i)
                docs.append(d)
                held += len(d)
                if held >= GROUP_TOKENS:
                    yield flush()
                    held = 0
        if docs:
            yield flush()

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, tiers=TIERS) -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_pack(tokenizer or default_tokenizer(), tuple(tiers)), _SCHEMA).withColumnRenamed("id", id_col)

"""Personal data: base patterns, and terms that still reveal a protected entity.

Base kinds are found by pattern and validity check in whole texts.  Each valid match is a protected
entity, known by the hash of its kind and text.  From all documents come the number of documents that
hold a term and the number that hold it together with an entity, wherever the two stand; a term
discloses an entity when

    p(entity | term) = together / (documents with the term + 1) >= ``DISCLOSURE``

and its pointwise information about the entity, log2 p(entity | term) - log2 p(entity), is at least
``BITS``.  Every occurrence of such a term in a document that holds the entity becomes a span of kind ``term``;
documents without the entity are left as they are.  ``sanitise`` replaces base
spans by their kind, generalises disclosing terms with digits or capitals to their class, removes others.

Null text is empty and has no spans.  Rows that repeat an id are searched one by one.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, slices, text_or_empty

DISCLOSURE = 0.8
BITS = 3.0
KINDS = ("email", "ip", "card", "phone")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match that fails from the start of a run of digits fails from its other digits too, so only starts are tried
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_COUNT_LIMIT = 400_000
BROADCAST_TERMS = 500_000


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    out = []
    if "@" in text:
        # a match has its "@", so a text is searched from the start of the run before each one on
        out += [("email", m.start(), m.end()) for m in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
                    out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str):
    """The pattern's leftmost non-overlapping matches; long runs without "@" are not searched again and again."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            yield m
            done = m.end()
        at = text.find("@", max(at + 1, done))


def spans_text(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode(), digest_size=8).digest(), "little", signed=True)


def document_terms(text: str, spans):
    """(term, start, end) of every word outside all base spans."""
    bounds = sorted((a, b) for _, a, b in spans)
    out, k, reach = [], 0, 0
    for m in _WORD.finditer(text):
        while k < len(bounds) and bounds[k][0] < m.end():
            reach = max(reach, bounds[k][1])
            k += 1
        if m.start() >= reach:
            out.append((m.group(), m.start(), m.end()))
    return out


_FOUND = "row long, id long, key long, n_email long, n_ip long, n_card long, n_phone long, base string, entities array<long>, terms array<struct<term:long,start:long,end:long>>"
_TERMS = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


def _entities(batches):
    """The distinct entities of each document."""
    for piece in slices(batches):
        out = []
        for text in piece.batch.column("text").to_pylist():
            out += {_hash(kind, text[a:b]) for kind, a, b in base_spans(text)}
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["entity"])


def _find(wanted, batches):
    """Base spans, and all terms of the documents that hold an entity in ``wanted``; None stands for all."""
    row = TaskContext.get().partitionId() << 36
    for piece in slices(batches):
        texts = piece.batch.column("text").to_pylist()
        rows = []
        for i, key, text in zip(piece.batch.column("id").to_pylist(), piece.batch.column("key").to_pylist(), texts):
            spans = base_spans(text)
            counts = [sum(s[0] == k for s in spans) for k in KINDS] if spans else (0, 0, 0, 0)
            held = sorted({e for e in (_hash(kind, text[a:b]) for kind, a, b in spans) if wanted is None or e in wanted})
            rows.append((row, i, key, *counts, spans_text(spans), held, document_terms(text, spans) if held else []))
            row += 1
        # terms are known by the same hash as in _count: that of their bytes
        words = [c[0].encode() for r in rows for c in r[-1]]
        joined = pa.RecordBatch.from_pydict({"text": pa.array([b" ".join(words).decode()], pa.string())})
        hashes = iter(_word_ids(next(slices([joined]))).tolist() if words else [])
        terms = [[{"term": next(hashes), "start": a, "end": b} for _, a, b in r[-1]] for r in rows]
        kinds = [pa.int64()] * 7 + [pa.string(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)), pa.array(terms, _TERMS)], names=["row", "id", "key", "n_email", "n_ip", "n_card", "n_phone", "base", "entities", "terms"])


def _word_ids(piece) -> np.ndarray:
    starts, ends, _ = piece.words()
    return piece.word_hashes(starts, ends).view(np.int64)


def _count(wanted, batches):
    """Documents by term, totalled in memory-sized parts; of the sorted ``wanted`` terms if given."""
    terms, numbers, held = [], [], 0

    def total():
        t, n = np.concatenate(terms), np.concatenate(numbers)
        order = np.argsort(t, kind="stable")
        t, n = t[order], n[order]
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        return t[first], np.add.reduceat(n, first)

    for piece in slices(batches):
        starts, ends, first = piece.words()
        if not len(starts):
            continue
        h = piece.word_hashes(starts, ends).view(np.int64)
        of = np.repeat(np.arange(piece.n), np.diff(first))
        if wanted is not None:
            known = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h if len(wanted) else np.zeros(len(h), bool)
            h, of = h[known], of[known]
            if not len(h):
                continue
        order = np.lexsort((of, h))
        h, of = h[order], of[order]
        new = np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1]))
        h = h[new]
        begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        terms.append(h[begin])
        numbers.append(np.diff(np.append(begin, len(h))))
        held += len(begin)
        if held > _COUNT_LIMIT:
            t, n = total()
            terms, numbers, held = [t], [n], len(t)
            if held > _COUNT_LIMIT // 2:
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(n)], names=["term", "n"])
                terms, numbers, held = [], [], 0
    if terms:
        t, n = total()
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(n)], names=["term", "n"])


def least_together(disclosure: float = DISCLOSURE) -> float:
    """With fewer joint documents than this no pair reaches the threshold: together / (documents + 1), documents >= together."""
    return disclosure / (1 - disclosure) if disclosure < 1 else float("inf")


def disclosing(found: DataFrame, entities: DataFrame, texts: DataFrame, total: int, disclosure: float = DISCLOSURE, bits: float = BITS) -> DataFrame:
    """(entity, term) pairs over the thresholds, from counts over all documents; ``entities`` has holders."""
    held = found.filter(F.size("terms") > 0).select(F.explode("entities").alias("entity"), F.array_distinct(F.transform("terms", lambda t: t["term"])).alias("terms"))
    together = held.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("together"))
    likely = together.filter(F.col("together") >= F.lit(least_together(disclosure) - 1e-9))
    likely = materialize(likely, "likely")
    terms = likely.select("term").distinct()
    few = terms.limit(BROADCAST_TERMS + 1).toPandas()["term"].to_numpy(np.int64)
    if len(few) <= BROADCAST_TERMS:  # 8 bytes each; more are joined
        sent = texts.sparkSession.sparkContext.broadcast(np.sort(few))
        wanted = texts.mapInArrow(lambda batches: _count(sent.value, batches), "term long, n long")
    else:
        wanted = texts.mapInArrow(lambda batches: _count(None, batches), "term long, n long").join(terms, "term", "left_semi")
    wanted = wanted.groupBy("term").agg(F.sum("n").alias("documents"))
    given = F.col("together") / (F.col("documents") + 1)
    return (
        likely.join(wanted, "term").join(entities, "entity")
        .filter((given >= disclosure - 1e-9) & (F.log2(given) - F.log2(F.col("holders") / F.lit(max(total, 1))) >= bits))
        .select("entity", "term")
    )


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bool = False) -> DataFrame:
    """``id_col``, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row; with ``key`` the hash of id and text too."""
    text = text_or_empty(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col), text).alias("key"), text.alias("text"))
    entities = texts.select("text").mapInArrow(_entities, "entity long").groupBy("entity").agg(F.count("*").alias("holders"))
    entities = materialize(entities.filter(F.col("holders") >= F.lit(least_together() - 1e-9)), "entities")
    few = [r.entity for r in entities.limit(BROADCAST_TERMS + 1).collect()] if BROADCAST_TERMS >= 0 else []
    sent = texts.sparkSession.sparkContext.broadcast(frozenset(few) if len(few) <= BROADCAST_TERMS else None)
    found = materialize(texts.mapInArrow(lambda batches: _find(sent.value, batches), _FOUND), "pii")
    pairs = disclosing(found, entities, texts.select("text"), found.count())
    reveal = (
        found.filter(F.size("terms") > 0).select("row", F.explode("entities").alias("entity"), "terms").select("row", "entity", F.explode("terms").alias("c")).select("row", "entity", "c.*")
        .join(pairs, ["entity", "term"]).groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("terms"))
    )
    added = F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"].cast("string"), s["end"].cast("string")))
    whole = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.array_join(added, ","))
    return found.drop("terms").join(reveal, "row", "left").select(
        F.col("id").alias(id_col), "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), F.when(F.col("terms").isNull(), F.col("base")).otherwise(whole).alias("spans"), *(["key"] if key else []),
    )


def sanitise(text: str, spans: str) -> str:
    """``text`` with its base spans replaced by their kind and its disclosing terms generalised or removed."""
    cuts = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s))
    out, at = [], 0
    for a, b, kind in cuts:
        if a < at:
            a = at
        if b <= a:
            continue
        out.append(text[at:a])
        if kind != "term":
            out.append(f"<{kind}>")
        elif any(c.isdigit() for c in text[a:b]):
            out.append("<number>")
        elif text[a:b][:1].isupper():
            out.append("<name>")
        at = b
    return "".join(out) + text[at:]


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with sanitised text.  Rows are known by id and text; null text stays null."""
    key, marks = (free_name(docs, n) for n in ("__key", "__marks"))
    name = lambda i, t: F.xxhash64(i, F.coalesce(t, F.lit("")))
    found = find_pii(docs, id_col, text_col, key=True).filter("spans != ''").select(F.col("key").alias(key), F.col("spans").alias(marks)).dropDuplicates([key])

    @F.pandas_udf("string")
    def clean(text, spans):
        return text.combine(spans, lambda t, m: t if t is None or not m else sanitise(t, m))

    joined = docs.withColumn(key, name(F.col(id_col), F.col(text_col))).join(found, key, "left")
    return joined.select(*[clean(F.col(text_col), F.col(marks)).alias(c) if c == text_col else F.col(c) for c in docs.columns])

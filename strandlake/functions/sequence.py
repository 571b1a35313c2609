"""Column expressions over base strings.  Positions are 0-based unless a name says otherwise.

k-mers up to 31 bases hash to a LONG (A0 C1 G2 T3, first base highest); longer windows are grouped by
their substring.  Null sequences give null.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASES = "ACGT"
#: fixed values: 4-bit codes of reads that hold N (C and G are not in the order of the 2-bit code)
WIDE_CODES = {"A": 0, "G": 1, "C": 2, "T": 3, "N": 4}


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value, body) -> Column:
    """``body`` of ``value``, evaluated once: an expression captured by a lambda is otherwise evaluated anew for
    every element."""
    return F.get(F.transform(F.array(_c(value)), body), F.lit(0))


def reverse_complement(seq, keep_unknown: bool = False) -> Column:
    """Upper-case complement read backwards; other letters become N, or stay as they are."""
    s = _c(seq)
    if not keep_unknown:
        s = F.regexp_replace(F.upper(s), "[^ACGT]", "N")
    return F.reverse(F.translate(s, "ACGTacgt", "TGCATGCA"))


def canonical(seq) -> Column:
    """Struct (sequence, was_reversed): the smaller strand; palindromes are not reversed."""
    s, rc = _c(seq), reverse_complement(seq)
    return F.struct(F.least(s, rc).alias("sequence"), (rc < s).alias("was_reversed"))


def restore_strand(seq, was_reversed) -> Column:
    return F.when(_c(was_reversed), reverse_complement(seq)).otherwise(_c(seq))


def kmer_hash(kmer) -> Column:
    """2 bits a base; null where another letter occurs.  Up to 31 bases."""
    k = F.upper(_c(kmer))
    return F.when(k.rlike("^[ACGT]+$"), F.conv(F.translate(k, BASES, "0123"), 4, 10).cast("long"))


def hash_kmer(value, k: int) -> Column:
    """The k-mer of a hash."""
    return F.translate(F.lpad(F.conv(_c(value).cast("string"), 10, 4), k, "0"), "0123", BASES)


def reverse_complement_hash(value, k: int) -> Column:
    return kmer_hash(reverse_complement(hash_kmer(value, k)))


def canonical_hash(kmer) -> Column:
    """Struct (hash, is_forward): the smaller of both strands' hashes."""
    both = F.struct(kmer_hash(kmer).alias("h"), kmer_hash(reverse_complement(kmer)).alias("r"))
    return let(both, lambda x: F.struct(F.least(x["h"], x["r"]).alias("hash"), (x["h"] <= x["r"]).alias("is_forward")))


def kmers(seq, k: int, step: int = 1) -> Column:
    """Array of (pos, kmer)."""
    s = _c(seq)
    last = F.length(s) - k
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.struct(i.alias("pos"), F.substring(s, i + 1, F.lit(k)).alias("kmer")))).otherwise(F.array())


def _canonical_texts(seq, k: int) -> Column:
    """Array of (kmer, pos, is_forward) in canonical form, without k-mers that hold other letters.  The read is
    complemented once; a k-mer's other strand is a substring of that."""
    masked = F.regexp_replace(F.upper(_c(seq)), "[^ACGT]", "N")

    def texts(x):
        last = F.length(x["s"]) - k
        at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        both = F.transform(at, lambda i: F.struct(F.substring(x["s"], i + 1, F.lit(k)).alias("f"), F.substring(x["r"], last - i + 1, F.lit(k)).alias("r"), i.alias("pos")))
        clean = F.filter(both, lambda y: ~F.contains(y["f"], F.lit("N")))
        return F.transform(clean, lambda y: F.struct(F.least(y["f"], y["r"]).alias("kmer"), y["pos"].alias("pos"), (y["f"] <= y["r"]).alias("is_forward")))

    return let(F.struct(masked.alias("s"), F.reverse(F.translate(masked, "ACGT", "TGCA")).alias("r")), texts)


def _text_hash(kmer: Column) -> Column:
    """Hash of a clean upper-case k-mer."""
    return F.conv(F.translate(kmer, BASES, "0123"), 4, 10).cast("long")


def canonical_kmers(seq, k: int) -> Column:
    """Array of (hash, pos, is_forward) of the k-mers without other letters."""
    return F.transform(_canonical_texts(seq, k), lambda x: F.struct(_text_hash(x["kmer"]).alias("hash"), x["pos"].alias("pos"), x["is_forward"].alias("is_forward")))


def mismatches(a, b) -> Column:
    """Array of (pos, base of a) where two strings differ, over the shorter one."""
    a, b = _c(a), _c(b)

    def differ(x):
        n = F.least(F.length(x["a"]), F.length(x["b"]))
        at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        here = F.filter(at, lambda i: F.substring(x["a"], i, F.lit(1)) != F.substring(x["b"], i, F.lit(1)))
        return F.transform(here, lambda i: F.struct((i - 1).alias("pos"), F.substring(x["a"], i, F.lit(1)).alias("base")))

    return F.when(a.isNotNull() & b.isNotNull(), let(F.struct(a.alias("a"), b.alias("b")), differ))


def _distances(a: pa.Array, b: pa.Array) -> pa.Array:
    """Differences over the shorter of two texts, a row at a time of arrays; null where one is null."""
    import numpy as np

    null = pc.or_(pc.is_null(a), pc.is_null(b))
    sides = []
    for x in (a, b):
        x = x.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(x.buffers()[1], np.int64, len(x) + 1, x.offset * 8)
        data = x.buffers()[2]
        sides.append(((np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets))
    if any(len(d) and d[o[0] : o[-1]].max(initial=0) > 127 for d, o in sides):  # characters, not bytes
        found = np.array([0 if x is None or y is None else sum(c != d for c, d in zip(x, y)) for x, y in zip(a.to_pylist(), b.to_pylist())], np.int32)
    else:
        (left, at), (right, bt) = sides
        n = np.minimum(np.diff(at), np.diff(bt))
        ends = np.cumsum(n)
        inner = np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n, n)
        differ = left[np.repeat(at[:-1], n) + inner] != right[np.repeat(bt[:-1], n) + inner]
        total = np.append(0, np.cumsum(differ))
        found = (total[ends] - total[ends - n]).astype(np.int32)
    return pc.if_else(null, pa.scalar(None, pa.int32()), pa.array(found, pa.int32()))


def hamming_within(a, b, most: int) -> Column:
    """Differences over the shorter string; null above ``most``.  Counted in arrays, so not for use within a lambda."""
    return let(F.arrow_udf(_distances, "int")(_c(a), _c(b)), lambda d: F.when(d <= most, d))


def count_of(seq, letter: str) -> Column:
    s = _c(seq)
    return F.length(s) - F.length(F.replace(s, F.lit(letter), F.lit("")))


def shannon_entropy(seq) -> Column:
    """Over the four bases, with shares of the whole length; 0 when empty."""
    s = F.upper(_c(seq))
    total = F.lit(0.0)
    for b in BASES:
        p = count_of(s, b) / F.length(s)
        total = total - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    return F.when(F.length(s) > 0, total).otherwise(0.0)


def n_positions(seq) -> Column:
    """Positions of N or n."""
    s = F.upper(_c(seq))
    return let(s, lambda x: F.filter(F.sequence(F.lit(0), F.length(x)), lambda i: F.substring(x, i + 1, F.lit(1)) == "N"))


def mask_n(seq) -> Column:
    """Struct (bases, positions): N written as A, and where."""
    return F.struct(F.translate(_c(seq), "Nn", "AA").alias("bases"), n_positions(seq).alias("positions"))


def unmask_n(bases, positions) -> Column:
    def put(x):
        at = F.when(F.length(x["b"]) > 0, F.sequence(F.lit(0), F.length(x["b"]) - 1)).otherwise(F.array().cast("array<int>"))
        return F.array_join(F.transform(at, lambda i: F.when(F.array_contains(x["p"], i), F.lit("N")).otherwise(F.substring(x["b"], i + 1, F.lit(1)))), "")

    return let(F.struct(_c(bases).alias("b"), _c(positions).alias("p")), put)


def center_windows(seq) -> Column:
    """Struct (left, right): windows either side of the middle, N as A; null where the read is too short."""
    s = F.translate(_c(seq), "Nn", "AA")
    n, mid = F.length(s), F.floor(F.length(s) / 2).cast("int")
    w = F.least(mid, F.when(n > 100, F.lit(32)).otherwise(F.floor(n * 32 / 100)).cast("int"))
    ok = (w > 0) & (mid + w <= n)
    return F.when(ok, F.struct(F.substring(s, mid - w + 1, w).alias("left"), F.substring(s, mid + 1, w).alias("right")))


def _syncmer_texts(seq, k: int, s: int, offsets: tuple[int, ...]) -> Column:
    """Canonical k-mers whose smallest s-mer, leftmost on ties and in letter order, stands at one of ``offsets``."""
    masked = F.regexp_replace(F.upper(_c(seq)), "[^ACGT]", "N")

    def inner(x):
        last = F.length(x) - s
        at = F.when(last >= 0, F.sequence(F.lit(1), last + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.substring(x, i, F.lit(s)))

    def chosen(y):
        own = lambda c: F.slice(y["inner"], c["pos"] + 1, k - s + 1)
        if tuple(offsets) == (0,):
            return F.filter(y["texts"], lambda c: F.array_min(own(c)) == F.get(y["inner"], c["pos"]))
        return F.filter(y["texts"], lambda c: F.array_position(own(c), F.array_min(own(c))).isin(*[o + 1 for o in offsets]))

    return let(F.struct(let(masked, inner).alias("inner"), _canonical_texts(seq, k).alias("texts")), chosen)


def syncmers(seq, k: int = 21, s: int = 10, offsets: tuple[int, ...] = (0,)) -> Column:
    """Array of (hash, pos, is_forward) of the k-mers whose smallest s-mer stands at one of ``offsets``:
    (0,) gives open syncmers, (0, k - s) closed ones."""
    return F.transform(_syncmer_texts(seq, k, s, offsets), lambda x: F.struct(_text_hash(x["kmer"]).alias("hash"), x["pos"].alias("pos"), x["is_forward"].alias("is_forward")))


def min_syncmer(seq, k: int = 21, s: int = 10) -> Column:
    """Smallest open syncmer as struct (hash, pos); null where there is none."""
    best = F.array_min(F.transform(_syncmer_texts(seq, k, s, (0,)), lambda x: F.struct(x["kmer"].alias("kmer"), x["pos"].alias("pos"))))
    return let(best, lambda x: F.when(x.isNotNull(), F.struct(_text_hash(x["kmer"]).alias("hash"), x["pos"].alias("pos"))))


def hint_byte(seq) -> Column:
    """Top 8 of the 42 bits of the smallest syncmer; 255 where there is none."""
    return F.coalesce(F.shiftright(min_syncmer(seq)["hash"], 34), F.lit(255)).cast("int")


def minimizers(seq, k: int, w: int, drop_repeats: bool = True) -> Column:
    """Array of hashes: the smallest canonical k-mer of each run of w k-mers."""

    def smallest(h):
        last = F.size(h) - w
        return F.when(last >= 0, F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.array_min(F.slice(h, i, w)))).otherwise(F.array().cast("array<string>"))

    def fresh(found):
        return F.filter(found, lambda x, i: (i == 0) | (x != F.get(found, i - 1)))

    # letter order is hash order, so only the chosen ones are hashed
    found = let(F.transform(_canonical_texts(seq, k), lambda x: x["kmer"]), smallest)
    return F.transform(let(found, fresh) if drop_repeats else found, _text_hash)


def min_kmer(seq, k: int = 21) -> Column:
    return _text_hash(F.array_min(F.transform(_canonical_texts(seq, k), lambda x: x["kmer"])))


def bottom_sketch(hashes, n: int) -> Column:
    """The n smallest distinct hashes, ascending, padded with null."""
    smallest = F.slice(F.array_sort(F.array_distinct(_c(hashes))), 1, n)
    return let(smallest, lambda h: F.concat(h, F.array_repeat(F.lit(None).cast("bigint"), F.lit(n) - F.size(h))))


def byte_values(text) -> Column:
    """Array of ASCII codes."""
    return F.transform(F.filter(F.split(_c(text), ""), lambda c: c != ""), lambda c: F.ascii(c))


def mean_byte(text) -> Column:
    """Integer mean of ASCII codes; 0 when empty."""
    total = F.aggregate(byte_values(text), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(F.length(_c(text)) > 0, F.floor(total / F.length(_c(text)))).otherwise(0).cast("int")


def norm2(text) -> Column:
    """Sum of squared codes."""
    return F.aggregate(byte_values(text), F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)


def byte_variance(text) -> Column:
    """Integer part of the variance around the integer mean."""
    total = lambda v: F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x)
    with_mean = let(byte_values(text), lambda v: F.struct(v.alias("v"), F.floor(total(v) / F.size(v)).alias("m")))
    squares = lambda y: F.aggregate(y["v"], F.lit(0).cast("long"), lambda a, x: a + (x - y["m"]) * (x - y["m"]))
    return F.when(F.length(_c(text)) > 0, let(with_mean, lambda y: F.floor(squares(y) / F.size(y["v"])))).otherwise(0).cast("long")


def profile(text, bins: int) -> Column:
    """Integer means of equal parts."""

    def means(v):
        lo = lambda b: F.floor(b * F.size(v) / bins).cast("int")
        part = lambda b: F.slice(v, lo(b) + 1, F.greatest(F.lit(0), lo(b + 1) - lo(b)))
        mean = lambda x: F.when(F.size(x) > 0, F.floor(F.aggregate(x, F.lit(0).cast("long"), lambda a, y: a + y) / F.size(x))).otherwise(0).cast("int")
        return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: mean(part(b)))

    return let(byte_values(text), means)


def ends_key(text, n: int = 16) -> Column:
    return F.concat(F.left(_c(text), F.lit(n)), F.right(_c(text), F.lit(n)))


def varint_size(value) -> Column:
    """Bytes of an unsigned LEB128 number."""
    v = _c(value).cast("long")
    size = F.lit(1)
    for k in range(1, 9):
        size = F.when(v >= (1 << (7 * k)), k + 1).otherwise(size)
    return size


def zigzag(value) -> Column:
    v = _c(value).cast("long")
    return F.when(v >= 0, v * 2).otherwise(v * -2 - 1)


def unzigzag(value) -> Column:
    v = _c(value).cast("long")
    return F.when(v % 2 == 0, F.floor(v / 2)).otherwise(-F.floor((v + 1) / 2)).cast("long")


@F.pandas_udf(T.BinaryType())
def varint(values: pd.Series) -> pd.Series:
    """LEB128 bytes."""

    def one(v):
        if v is None or v != v:
            return None
        v, out = int(v), bytearray()
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
        return bytes(out)

    return values.map(one)


@F.pandas_udf(T.BinaryType())
def pack_bases(seqs: pd.Series) -> pd.Series:
    """A width byte (2 or 4), the length as LEB128, then codes, lowest bits first.  Other letters count as N."""
    import numpy as np

    narrow, wide = np.full(256, 255, np.uint8), np.full(256, WIDE_CODES["N"], np.uint8)
    for i, b in enumerate(BASES):
        narrow[ord(b)] = narrow[ord(b.lower())] = i
    for b, i in WIDE_CODES.items():
        wide[ord(b)] = wide[ord(b.lower())] = i

    def one(s):
        if s is None:
            return None
        raw = np.frombuffer(s.encode("latin-1", "replace"), np.uint8)
        bits = 2 if (narrow[raw] < 4).all() else 4
        codes = (narrow if bits == 2 else wide)[raw]
        per = 8 // bits
        codes = np.concatenate([codes, np.zeros(-len(codes) % per, np.uint8)]).reshape(-1, per)
        body = np.bitwise_or.reduce(codes << (np.arange(per, dtype=np.uint8) * bits), axis=1).astype(np.uint8) if len(codes) else codes.ravel()
        n, head = len(raw), bytearray([bits])
        while n > 127:
            head.append(n & 127 | 128)
            n >>= 7
        head.append(n)
        return bytes(head) + body.tobytes()

    return seqs.map(one)


@F.pandas_udf(T.StringType())
def unpack_bases(packed: pd.Series) -> pd.Series:
    import numpy as np

    letters = {2: np.frombuffer(BASES.encode(), np.uint8), 4: np.frombuffer(b"".join(b.encode() for b, _ in sorted(WIDE_CODES.items(), key=lambda x: x[1])) + b"N" * 11, np.uint8)}

    def one(data):
        if data is None:
            return None
        bits, n, shift, at = data[0], 0, 0, 1
        while True:
            n |= (data[at] & 127) << shift
            shift += 7
            at += 1
            if data[at - 1] < 128:
                break
        raw = np.frombuffer(data, np.uint8, offset=at)
        codes = (raw[:, None] >> (np.arange(8 // bits, dtype=np.uint8) * bits)) & ((1 << bits) - 1)
        return letters[bits][codes.ravel()[:n]].tobytes().decode()

    return packed.map(one)

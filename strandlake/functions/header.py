"""Column expressions over read headers.

Two dialects are known; others, and numbers beyond the field widths, stay raw text:
SRA     ``@PREFIX.N I:R:F:L:T:X:Y[/P]``
Casava  ``@I:R:F:L:T:X:Y[:UMI] COMMENT``
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import let

_SRA = r"^@([^ ]+)\.(\d+) ([^: ]+:[^: ]+:[^: ]+):(\d+):(\d+):(\d+):(\d+)(/[12])?$"
_CASAVA = r"^@([^: ]+:[^: ]+:[^: ]+):(\d+):(\d+):(\d+):(\d+)((?::[^ ]+)?) (.+)$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dialect(header) -> Column:
    h = _c(header)
    return F.when(h.rlike(_SRA), "sra").when(h.rlike(_CASAVA), "casava").otherwise("raw")


def _number(text: Column, most: int) -> Column:
    n = text.try_cast("long")
    return F.when((n >= 0) & (n <= most), n)


def _fields(h: Column, pattern: str, names: dict[str, int], numbers: dict[str, int]) -> Column:
    part = lambda k: F.regexp_extract(h, pattern, k)
    out = [part(k).alias(n) for n, k in names.items()]
    limits = {"read_num": 2**32 - 1, "lane": 255, "tile": 2**16 - 1, "x": 2**16 - 1, "y": 2**16 - 1}
    kinds = {"read_num": "long", "lane": "short", "tile": "int", "x": "int", "y": "int"}
    out += [_number(part(k), limits[n]).cast(kinds[n]).alias(n) for n, k in numbers.items()]
    whole = F.struct(*out)
    fits = F.lit(True)
    for n, k in numbers.items():
        fits = fits & _number(part(k), limits[n]).isNotNull()
    return F.when(h.rlike(pattern) & fits, whole)


def parse_sra(header) -> Column:
    """Struct (prefix, combo, pair, read_num, lane, tile, x, y), or null."""
    return _fields(_c(header), _SRA, {"prefix": 1, "combo": 3, "pair": 8}, {"read_num": 2, "lane": 4, "tile": 5, "x": 6, "y": 7})


def parse_casava(header) -> Column:
    """Struct (combo, umi, comment, lane, tile, x, y), or null; umi is empty or what follows the seventh field."""
    return _fields(_c(header), _CASAVA, {"combo": 1, "umi": 6, "comment": 7}, {"lane": 2, "tile": 3, "x": 4, "y": 5})


def build_sra(p) -> Column:
    p = _c(p)
    return F.concat(F.lit("@"), p["prefix"], F.lit("."), p["read_num"].cast("string"), F.lit(" "), F.concat_ws(":", p["combo"], p["lane"].cast("string"), p["tile"].cast("string"), p["x"].cast("string"), p["y"].cast("string")), p["pair"])


def build_casava(p) -> Column:
    p = _c(p)
    return F.concat(F.lit("@"), F.concat_ws(":", p["combo"], p["lane"].cast("string"), p["tile"].cast("string"), p["x"].cast("string"), p["y"].cast("string")), p["umi"], F.lit(" "), p["comment"])


def lossless(header) -> Column:
    """Does the header come back from its fields?  Leading zeros do not, and such headers stay raw."""
    h = _c(header)
    back = F.coalesce(build_sra(parse_sra(h)), build_casava(parse_casava(h)))
    return F.coalesce(back == h, F.lit(False))


def template(header) -> Column:
    """Struct (prefix, x, y, comment) of headers with seven fields or more: prefix holds the first five."""
    h = _c(header)
    name, comment = F.substring_index(h, " ", 1), F.when(F.instr(h, " ") > 0, F.expr("null").cast("string"))
    parts = F.split(name, ":")
    comment = F.when(F.instr(h, " ") > 0, F.substring(h, F.length(name) + F.lit(2), F.length(h)))
    x, y = F.get(parts, F.lit(5)).try_cast("int"), F.get(parts, F.lit(6)).try_cast("int")
    return F.when((F.size(parts) >= 7) & x.isNotNull() & y.isNotNull(), F.struct(F.array_join(F.slice(parts, 1, 5), ":").alias("prefix"), x.alias("x"), y.alias("y"), comment.alias("comment")))


def pair_pattern(first, second) -> Column:
    """How mates' headers match: 1 ``*/1`` and ``*/2``, 2 equal, 3 ``* 1:#`` and ``* 2:#``, 0 none."""
    a, b = _c(first), _c(second)
    stem = lambda x, n: F.substring(x, F.lit(1), F.length(x) - n)
    slash = a.endswith("/1") & b.endswith("/2") & (stem(a, 1) == stem(b, 1))
    cut = lambda x: F.substring_index(x, " ", 1)
    rest = lambda x: F.substring(x, F.length(cut(x)) + F.lit(2), F.length(x))
    spaced = (cut(a) == cut(b)) & rest(a).startswith("1:") & rest(b).startswith("2:") & (F.substring(rest(a), 2, 1 << 20) == F.substring(rest(b), 2, 1 << 20))
    return F.when(slash, 1).when(a == b, 2).when(spaced, 3).otherwise(0)


def tokens(header) -> Column:
    """Runs of letters, of digits, and single other characters."""
    return F.regexp_extract_all(_c(header), F.lit(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]"), F.lit(0))


def token_codes(header, previous) -> Column:
    """Array of (kind, value) against the previous header: match, delta (numbers up to 255 apart without
    leading zeros), number, alpha, other."""
    number = lambda t: t.rlike("^(0|[1-9][0-9]{0,17})$")

    pair = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    def against(before):
        def one(t, i):
            old = F.get(before, i)
            step = F.when(number(t) & number(F.coalesce(old, F.lit("x"))), t.try_cast("long") - old.try_cast("long"))
            return (
                F.when(t == old, pair("match", F.lit("")))
                .when((step > 0) & (step < 256), pair("delta", step.cast("string")))
                .when(t.rlike("^[0-9]"), pair("number", t))
                .when(t.rlike("^[A-Za-z]"), pair("alpha", t))
                .otherwise(pair("other", t))
            )

        return F.transform(tokens(header), one)

    return let(tokens(F.coalesce(_c(previous), F.lit(""))), against)

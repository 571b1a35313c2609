"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

Tokens are dealt in blocks of ``BLOCK`` words.  Sources get blocks by highest quotients
target/(2k+1); each source's quota is apportioned to its shards in the same way; within a shard the
documents lie in seeded order and the quota takes whole passes plus a cyclic run of blocks from a
seeded start, so a document gives at most two times its size.

Only quotients near the exact share are generated: with P parties a quota differs from its exact
share by at most share * P / 2 + 1, so about 2P + 5P rows hold every quotient that can decide.

Null text has size 0; a null source is a source of its own, last in order.  Documents without words
are taken 0 times.  Repeated rows take part one by one.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize

BLOCK = 16
SHARD_ROWS = 65536
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def _seeded(*parts) -> Column:
    """32 seeded bits."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), *parts)), 1, 8), 16, 10).cast("long")


def sainte_lague(parties: DataFrame, within: list[str], party: str, votes: str, seats: str) -> DataFrame:
    """``parties`` with ``quota``: the seats of each ``within`` group, dealt by highest quotients."""
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    share = F.col(votes) / F.col("__all")
    exact = share * F.col(seats)
    spread = F.ceil(share * F.col("__parties") / 2) + 2
    near = (
        parties.withColumn("__all", F.sum(votes).over(group)).withColumn("__parties", F.count("*").over(group))
        .withColumn("__low", F.when(F.col("__all") > 0, F.greatest(F.lit(0), F.floor(exact) - spread)).otherwise(0).cast("long"))
        .withColumn("__high", F.when(F.col("__all") > 0, F.floor(exact) + spread).otherwise(0).cast("long"))
        .withColumn("__left", F.col(seats) - F.sum("__low").over(group))
    )
    order = group.orderBy(F.col("__quotient").desc(), F.col(party))
    won = (
        near.select(*within, party, "__left", F.col(votes).alias("__votes"), F.explode(F.sequence("__low", "__high")).alias("__k"))
        .withColumn("__quotient", F.col("__votes") / (2 * F.col("__k") + 1)).filter("__quotient > 0")
        .withColumn("__rank", F.row_number().over(order)).filter("__rank <= __left")
        .groupBy(*within, party).agg(F.count("*").alias("__won"))
    )
    return (
        near.join(won, [*within, party], "left").withColumn("quota", F.col("__low") + F.coalesce("__won", F.lit(0)))
        .select(*parties.columns, "quota")
    )


def source_targets(rows: DataFrame, factor: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Per source: source_size and target.  Weights 3, 1, 2, repeating, share ``factor`` of all sizes;
    no target is above ``cap`` times its source's size, and what is over is shared again by weight."""
    every = Window.partitionBy(F.lit(0))
    filled = Window.partitionBy(F.lit(0)).orderBy(F.col("__cap") / F.col("__w"), "skey").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(filled), F.lit(0.0))
    return (
        rows.groupBy("skey").agg(F.sum("size").alias("source_size"))
        .withColumn("__n", F.row_number().over(every.orderBy("skey")))
        .withColumn("__w", F.expr("element_at(array(3.0D, 1.0D, 2.0D), cast((__n - 1) % 3 + 1 as int))"))
        .withColumn("__cap", cap * F.col("source_size")).withColumn("__total", factor * F.sum("source_size").over(every))
        .withColumn("__level", (F.col("__total") - before("__cap")) / (F.sum("__w").over(every) - before("__w")))
        .withColumn("__full", F.col("__level") * F.col("__w") >= F.col("__cap"))
        .withColumn("__level", F.max(F.when(~F.col("__full"), F.col("__level"))).over(every))
        .withColumn("target", F.when(F.col("__full"), F.col("__cap")).otherwise(F.col("__level") * F.col("__w")))
        .select("skey", "source_size", "target", F.round(F.col("__total") / BLOCK).cast("long").alias("blocks"))
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id_col``, size, source_size, target, taken for each row of ``docs``."""
    skey = F.when(F.col(source_col).isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), F.col(source_col)))
    rows = docs.select(F.col(id_col).alias("id"), skey.alias("skey"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = materialize(rows.withColumn("key", F.md5(F.concat_ws("|", F.lit(SEED), F.col("id").cast("string")))), "mix")
    shards = 1 + rows.count() // SHARD_ROWS
    rows = rows.withColumn("shard", F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), F.lit(shards)))

    sources = sainte_lague(source_targets(rows), [], "skey", "target", "blocks").withColumnRenamed("quota", "source_quota")
    by_shard = rows.groupBy("skey", "shard").agg(F.sum("size").alias("words")).join(sources, "skey")
    quotas = sainte_lague(by_shard, ["skey"], "shard", "words", "source_quota")
    have = F.col("have")
    quotas = (
        quotas.withColumn("have", F.greatest(F.lit(1), F.ceil(F.col("words") / BLOCK))).withColumn("quota", F.least("quota", 2 * have))
        .withColumn("passes", F.floor(F.col("quota") / have)).withColumn("run", F.col("quota") % have)
        .withColumn("start", F.pmod(_seeded("skey", F.col("shard").cast("string")), have))
        .select("skey", "shard", "passes", "source_size", "target",
                (F.col("start") * BLOCK).alias("from1"), F.least("words", (F.col("start") + F.col("run")) * BLOCK).alias("to1"),
                F.greatest(F.lit(0), (F.col("start") + F.col("run") - have) * BLOCK).alias("to2"))
    )
    order = Window.partitionBy("skey", "shard").orderBy("key", "id", "size")
    overlap = lambda a, b: F.greatest(F.lit(0), F.least(F.col("end"), b) - F.greatest(F.col("end") - F.col("size"), a))
    return (
        rows.withColumn("end", F.sum("size").over(order))
        .join(quotas, ["skey", "shard"])
        .select(
            F.col("id").alias(id_col), "size", "source_size", "target",
            (F.col("passes") * F.col("size") + overlap(F.col("from1"), F.col("to1")) + overlap(F.lit(0), F.col("to2"))).cast("long").alias("taken"),
        )
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them, to the nearest whole copy; documents without
    words, of which a mix in words takes nothing, stay as they are."""
    row, words, times, copy = (free_name(docs, n) for n in ("__row", "__words", "__times", "__copy"))
    taken = mix(docs, id_col, text_col, source_col)
    whole = F.when(F.col("size") == 0, 1).otherwise(F.floor((F.col("taken") + F.col("size") / 2) / F.col("size"))).cast("int")
    copies = taken.select(F.col(id_col).alias(row), F.col("size").alias(words), whole.alias(times))
    # rows that repeat an id and a size share the larger number of copies that the mix gave them
    copies = copies.groupBy(row, words).agg(F.max(times).alias(times)).filter(F.col(times) > 0)
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0))
    return (
        docs.join(copies, docs[id_col].eqNullSafe(copies[row]) & (size == F.col(words)))
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)
    )

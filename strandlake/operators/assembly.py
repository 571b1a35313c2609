"""Unitigs, greedy contigs and template walks.

Unbranched paths are joined by pointer doubling over the oriented k-mer table.  Greedy extension is
sequential by nature; a component stays within one task.
"""

from __future__ import annotations

import operator
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..session import discard, keep
from . import stems
from .kmers import MINIMIZED, canonical_codes, coded_minimizers, strings
from .reorder import number

_RC = str.maketrans("ACGT", "TGCA")
_DIGITS = str.maketrans("ACGT", "0123")


def _rc(s: str) -> str:
    return s.translate(_RC)[::-1]


def unitigs(counts: DataFrame, k: int) -> DataFrame:
    """(contig_id, sequence) of the maximal unbranched paths of canonical k-mers, longest first.

    Every k-mer stands in both orientations; a link joins an oriented k-mer to the one that follows when
    neither has another choice.  Each end reaches along its path in doubling steps; cycles are opened at their
    smallest k-mer.  Paths and their mirror images give one unitig, the smaller text.
    """
    forward = counts.select(F.col("kmer").alias("node"))
    nodes = forward.unionByName(counts.select(S.reverse_complement("kmer").alias("node"))).distinct()
    step = nodes.select("node", F.explode(F.array(*[F.lit(b) for b in S.BASES])).alias("base")).select("node", F.concat(F.substring("node", F.lit(2), F.lit(k - 1)), "base").alias("next"))
    edges = keep(step.join(nodes.select(F.col("node").alias("next")), "next").select("node", "next"), "edges")
    single_out = edges.groupBy("node").agg(F.count("*").alias("o")).filter("o = 1").select("node")
    single_in = edges.groupBy("next").agg(F.count("*").alias("i")).filter("i = 1").select("next")
    links = edges.join(single_out, "node", "left_semi").join(single_in, "next", "left_semi").filter((F.col("node") != F.col("next")) & (F.col("next") != S.reverse_complement("node")))
    links = keep(links.select("node", F.col("next").alias("to")), "links")
    # pointer doubling backwards: head and distance of every node
    state = keep(nodes.join(links.select(F.col("to").alias("node"), F.col("node").alias("back")), "node", "left").select("node", F.coalesce("back", "node").alias("at"), F.when(F.col("back").isNull(), 0).otherwise(1).cast("long").alias("far"), F.least("node", F.coalesce("back", "node")).alias("low")), "walk")
    while True:
        ahead = state.select(F.col("node").alias("at"), F.col("at").alias("at2"), F.col("far").alias("far2"), F.col("low").alias("low2"))
        new = keep(state.join(ahead, "at").select("node", F.col("at2").alias("at"), (F.col("far") + F.col("far2")).alias("far"), F.least("low", "low2").alias("low"), (F.col("at") != F.col("at2")).alias("moved")), "walk")
        total = new.agg(F.max(F.when(F.col("moved"), F.col("far"))).alias("far"), F.count("*").alias("n")).first()
        state = new.select("node", "at", "far", "low")
        if total["far"] is None or total["far"] > 2 * total["n"]:
            break
    heads = links.select(F.col("to").alias("node"))
    on_cycle = state.filter(F.col("at") != F.col("node")).join(heads.select(F.col("node").alias("at")), "at", "left_semi")
    paths = state.join(on_cycle.select("node"), "node", "left_anti").select("node", F.col("at").alias("head"), F.col("far").alias("rank"))
    if not on_cycle.isEmpty():
        cut = links.join(on_cycle.groupBy("low").agg(F.count("*").alias("c")).select(F.col("low").alias("to")), "to", "left_anti")
        cut = keep(cut, "cut")
        cycle = keep(on_cycle.select("node").join(cut.select(F.col("to").alias("node"), F.col("node").alias("back")), "node", "left").select("node", F.coalesce("back", "node").alias("at"), F.when(F.col("back").isNull(), 0).otherwise(1).cast("long").alias("far")), "cycle")
        while True:
            ahead = cycle.select(F.col("node").alias("at"), F.col("at").alias("at2"), F.col("far").alias("far2"))
            new = keep(cycle.join(ahead, "at").select("node", F.col("at2").alias("at"), (F.col("far") + F.col("far2")).alias("far"), (F.col("at") != F.col("at2")).alias("moved")), "cycle")
            cycle = new.select("node", "at", "far")
            if new.filter("moved").isEmpty():
                break
        paths = paths.unionByName(cycle.select("node", F.col("at").alias("head"), F.col("far").alias("rank")))
    last = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.substring("node", k, 1).alias("b")))), lambda x: x["b"])
    texts = paths.groupBy("head").agg(last.alias("ends")).select(F.concat(F.substring("head", F.lit(1), F.lit(k - 1)), F.array_join("ends", "")).alias("raw"))
    texts = texts.select(F.least("raw", S.reverse_complement("raw")).alias("sequence")).distinct()
    return number(texts, [F.length("sequence").desc(), F.col("sequence")], "contig_id", ["sequence"]).select("contig_id", "sequence")


def _minimizers(s: str, k: int, w: int) -> list[tuple[str, int, bool]]:
    """(canonical k-mer, place, is it the forward text) of the smallest in every ``w`` neighbouring clean k-mers."""
    n, back = len(s), _rc(s)
    clean = [(min(f, r), i, f <= r) for i in range(n - k + 1) for f, r in ((s[i : i + k], back[n - k - i : n - i]),) if not set(f) - set("ACGT")]
    return list(dict.fromkeys(min(clean[i : i + w]) for i in range(len(clean) - w + 1)))


def _coded_minimizers(texts: list[str], k: int, w: int) -> list[list[tuple[int, int, bool]]]:
    """``_minimizers`` of many texts, with codes for k-mers; ASCII, k at most 31."""
    out = []
    for low in range(0, len(texts), MINIMIZED):
        some = texts[low : low + MINIMIZED]
        row, *found = coded_minimizers(pa.array(some, pa.large_string()), k, w)
        found, cuts = list(zip(*[c.tolist() for c in found])), np.searchsorted(row, np.arange(len(some) + 1)).tolist()
        out += [found[x:y] for x, y in zip(cuts[:-1], cuts[1:])]
    return out


def _apart(a: str, b: str, most: int) -> int | None:
    """Hamming distance if it is at most ``most``."""
    d = 0 if a == b else sum(map(operator.ne, a, b))
    return d if d <= most else None


#: fixed value: reads of whole components that are worked on at once
CONTIG_READS = 1 << 16


def greedy_contigs(reads: DataFrame, components: DataFrame, least: int = 31, most: int = 4, steps: int = 10_000, k: int = 15, w: int = 11, probes: int = 200) -> DataFrame:
    """(contig_id, sequence, reads): seeds in read order, extended right and then left by the unused read with the fewest
    mismatches over an overlap of ``least`` bases or more; the first found wins ties.

    Reads are found by the minimisers of the contig's end, as long as the first read: the ``probes`` latest of a
    minimiser, either strand.  A component is within one task, whose time is linear in its reads; components go by as a stream,
    and minimisers of many of them are found at once.
    """

    def contigs(seqs: dict[int, str], known: dict[str, list], find: Callable):
        end = len(next(iter(seqs.values())))
        lists: dict = {}
        for i, s in seqs.items():
            for kmer, pos, forward in known[s]:
                lists.setdefault(kmer, []).append((i, pos, forward))
        unused = dict.fromkeys(seqs)

        def best(contig, right):
            """(distance, read, oriented text, bases added)."""
            found, region = None, contig[-end:] if right else contig[:end]
            shift = len(contig) - len(region) if right else 0
            marks = known.get(region)
            if marks is None:
                marks = known[region] = find(region)
            for kmer, pos, forward in marks:
                for i, at, same in reversed(lists.get(kmer, [])[-probes:]):
                    if i not in unused:
                        continue
                    read = seqs[i] if same == forward else _rc(seqs[i])
                    start = shift + pos - (at if same == forward else len(read) - at - k)  # of the read, on the contig
                    if right:
                        overlap = len(contig) - start
                        if start < 0 or overlap >= len(read) or overlap < least:
                            continue
                        d = _apart(contig[start:], read[:overlap], most)
                    else:
                        overlap = len(read) + start
                        if start >= 0 or overlap > len(contig) or overlap < least:
                            continue
                        d = _apart(contig[:overlap], read[-start:], most)
                    if d is not None and (found is None or d < found[0]):
                        found = (d, i, read, len(read) - overlap)
                        if d == 0:
                            return found
            return found

        for seed in seqs:
            if seed not in unused:
                continue
            del unused[seed]
            contig, members = seqs[seed], [seed]
            for right in (True, False):
                for _ in range(steps):
                    if not unused or not (found := best(contig, right)):
                        break
                    _, i, read, added = found
                    contig = contig + read[-added:] if right else read[:added] + contig
                    members.append(i)
                    del unused[i]
            yield seed, contig, sorted(members)

    def worked(groups):
        texts = list(dict.fromkeys(t for seqs in groups if len(seqs) > 1 for s in seqs.values() for t in (s, _rc(s))))
        if k <= 31 and all(map(str.isascii, texts)):
            known = dict(zip(texts, _coded_minimizers(texts, k, w)))
            find = lambda s: [(int(kmer.translate(_DIGITS), 4), pos, forward) for kmer, pos, forward in _minimizers(s, k, w)]
        else:
            find = lambda s: _minimizers(s, k, w)
            known = {t: find(t) for t in texts}
        out = []
        for seqs in groups:
            if len(seqs) == 1:
                out += [(i, s, [i]) for i, s in seqs.items()]
            else:
                out += contigs(seqs, known, find)
        ids, sequences, members = zip(*out)
        for low in range(0, len(out), 1 << 14):
            part = slice(low, low + (1 << 14))
            yield pa.RecordBatch.from_arrays([pa.array(ids[part], pa.int64()), pa.array(sequences[part], pa.string()), pa.array(members[part], pa.list_(pa.int64()))], names=["contig_id", "sequence", "reads"])

    def run(batches):
        groups, label, n = [], None, 0
        for batch in batches:
            for at, i, s in zip(*[c.to_pylist() for c in batch.columns]):
                if not groups or at != label:
                    if n >= CONTIG_READS:
                        yield from worked(groups)
                        groups, n = [], 0
                    groups.append({})
                    label = at
                groups[-1][i] = s.upper()
                n += 1
        if groups:
            yield from worked(groups)

    rows = reads.select("read_idx", "sequence").join(components.select("read_idx", "label").hint("merge"), "read_idx").select(F.col("label"), F.col("read_idx").cast("long").alias("read_idx"), "sequence")
    # as many tasks as the session names: small rows mean much work here
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "label").sortWithinPartitions("label", "read_idx").mapInArrow(run, "contig_id long, sequence string, reads array<long>")


def seeds(counts: DataFrame, least: int = 3, most: int | None = 50_000) -> DataFrame:
    """The k-mers to start templates from: frequent ones, most frequent first; a top-k where ``most`` is given."""
    found = counts.filter(F.col("count") >= least)
    return found.orderBy(F.col("count").desc(), "kmer").limit(most) if most else found


def correct_kmers(counts: DataFrame, weak: int = 2, strong: int = 3, k: int | None = None) -> DataFrame:
    """(kmer, corrected): k-mers below ``weak`` and the most frequent k-mer that differs in one end base, if it
    has ``strong`` occurrences.  With ``k``, the length of all of them, up to 31, they are matched as numbers."""
    if k and k <= 31:
        joined = _coded_corrections(counts, weak, strong, k)
    else:
        n = F.length("kmer")
        rare = counts.filter(F.col("count") < weak).select("kmer", F.explode(F.array(*[F.lit(b) for b in S.BASES])).alias("base"))
        ends = rare.select("kmer", F.explode(F.array(F.concat(F.substring("kmer", F.lit(1), n - 1), "base"), F.concat("base", F.substring("kmer", F.lit(2), n - 1)))).alias("raw")).filter("raw <> kmer")
        # the planner takes exploded tables for small ones
        joined = ends.withColumn("corrected", F.least("raw", S.reverse_complement("raw"))).join(counts.filter(F.col("count") >= strong).select(F.col("kmer").alias("corrected"), "count").hint("merge"), "corrected")
    w = Window.partitionBy("kmer").orderBy(F.col("count").desc(), "corrected")
    return joined.withColumn("__r", F.row_number().over(w)).filter("__r = 1").select("kmer", "corrected")


def _coded_corrections(counts: DataFrame, weak: int, strong: int, k: int) -> DataFrame:
    def run(entries, n, asked, side):
        own = np.where(side == 0, asked, stems.mirrored(asked, k))
        parts = []
        for b in range(4):
            key = (asked & ~np.int64(3)) | b
            at, hit = stems.found_at(entries, key)
            hit &= key != asked
            parts.append((own[hit], np.minimum(key[hit], stems.mirrored(key[hit], k)), n[at[hit]]))
        return [np.concatenate(c) for c in zip(*parts)]

    return stems.match(counts, k, False, run, "kmer string, corrected string, count long", lambda n: n >= strong, lambda n: n < weak)


def best_steps(counts: DataFrame, k: int) -> DataFrame:
    """(node, next): from each oriented k-mer the most frequent one that continues it; of equals the first base."""
    if k <= 31:
        return _coded_steps(counts, k, "node string, next string")
    nodes = counts.select(F.col("kmer").alias("node")).unionByName(counts.select(S.reverse_complement("kmer").alias("node"))).distinct()
    step = nodes.select("node", F.explode(F.array(*[F.lit(b) for b in S.BASES])).alias("base")).withColumn("next", F.concat(F.substring("node", F.lit(2), F.lit(k - 1)), "base"))
    known = step.withColumn("kmer", F.least("next", S.reverse_complement("next"))).join(counts.select("kmer", "count").hint("merge"), "kmer")
    # the largest count, and of those the smallest base: letters of DNA sort as their order
    return known.groupBy("node").agg(F.min_by("next", F.struct((-F.col("count")).alias("c"), "base")).alias("next"))


def best_codes(entries: np.ndarray, n: np.ndarray, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of the oriented k-mers ``asked`` that have a step, sorted, and the best one."""
    m = (1 << (2 * (k - 1))) - 1
    asked = np.unique(asked)  # a palindrome stands on both sides
    best, most = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
    for b in range(4):
        key = ((asked & m) << 2) | b
        at, hit = stems.found_at(entries, key)
        hit[hit] = n[at[hit]] > most[hit]
        best[hit], most[hit] = key[hit], n[at[hit]]
    return asked[most > 0], best[most > 0]


def _coded_steps(counts: DataFrame, k: int, schema: str) -> DataFrame:
    """The best step of each oriented k-mer; codes of k-mers where ``schema`` has numbers."""
    return stems.match(counts, k, True, lambda entries, n, asked, side: list(best_codes(entries, n, asked, k)), schema)


#: fixed values: steps that one row packs, joins of rows into longer ones (of small and of large tables), walks that are sent to the
#: table, and seeds of the first batch
STRIDE, DOUBLINGS, SMALL, FEW, BATCH = 31, (5, 3), 1 << 22, 1 << 18, 1 << 17


def _packed_end(node, path, k: int):
    """The k-mer behind ``path`` (a bit above 2 bits a step), of columns."""
    steps = F.floor(F.log2(path) / 2 + 1e-9).cast("int")
    mask = F.lit((1 << (2 * k)) - 1)
    bits = path.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), 2 * steps))
    kept = F.call_function("shiftleft", node, F.least(2 * steps, F.lit(2 * k)))
    return F.when(steps >= k, bits.bitwiseAND(mask)).otherwise(kept.bitwiseOR(bits).bitwiseAND(mask))


def paths(counts: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(node, path) twice: some of the next best steps of each oriented k-mer, and longer paths of those at which a path ends.

    ``path`` has 2 bits a step under a leading 1, up to ``STRIDE`` steps; a k-mer without a step has no row.  Steps of k-mers whose
    stems share a minimiser are joined where they are matched, which leaves the k-mers that are entered from elsewhere; only
    their paths are joined by shuffles.
    """
    m = (1 << (2 * (k - 1))) - 1
    bucket = lambda stem: stems.by_minimizer(stem, k)

    def run(entries, n, asked, side):
        node, following = best_codes(entries, n, asked, k)
        path, size, end = 4 | (following & 3), np.ones(len(node), np.int64), following
        for _ in range(5):
            at, more = stems.found_at(node, end)
            more &= size + size[at] <= STRIDE if len(node) else False
            if not more.any():
                break
            at = at[more]
            more_path, more_size, more_end = path.copy(), size.copy(), end.copy()
            more_path[more] = (path[more] << (2 * size[at])) | (path[at] ^ (np.int64(1) << (2 * size[at])))
            more_size[more] += size[at]
            more_end[more] = end[at]
            path, size, end = more_path, more_size, more_end
        # entered from another bucket, or the end of a path within this one
        entered = bucket(node >> 2) != bucket(node & m)
        at, here = stems.found_at(node, end)
        entered[at[here]] = True
        return [node, path, entered]

    found = keep(stems.match(counts, k, True, run, "node long, path long, entered boolean", bucket=bucket), "steps")
    every, long_ = found.select("node", "path"), found.filter("entered").select("node", "path")
    for n in range(DOUBLINGS[0] if long_.count() <= SMALL else DOUBLINGS[1]):
        more = long_.select(F.col("node").alias("end"), F.col("path").alias("more"))
        size = lambda x: F.floor(F.log2(x) / 2 + 1e-9).cast("int")
        joined = long_.withColumn("end", _packed_end(F.col("node"), F.col("path"), k)).join(more.hint("merge"), "end", "left")
        whole = F.call_function("shiftleft", F.col("path"), 2 * size(F.col("more"))).bitwiseOR(F.col("more").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), 2 * size(F.col("more")))))
        before = long_
        long_ = keep(joined.select("node", F.when(size(F.col("path")) + size(F.col("more")) <= STRIDE, whole).otherwise(F.col("path")).alias("path")), "steps")
        if n:
            discard(before)
    return every, long_


def _walk_right(rows: DataFrame, tables: tuple[DataFrame, DataFrame], k: int, reach: int) -> DataFrame:
    """``rows`` (name, text) walked on from the last k-mer of ``text``.

    A walk ends where there is no neighbour, where the text holds the best one, and after ``reach`` bases.  All rows walk at
    once, a path a join; few of them are sent to the table, so that it is not shuffled.
    """
    schema = "name long, text string, added int, node long, open boolean"

    def start(batches):
        for batch in batches:
            text = batch.column(1).to_pylist()
            node = [int(t[-k:].translate(_DIGITS), 4) for t in text]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([0] * len(text), pa.int32()), pa.array(node, pa.int64()), pa.array([reach > 0] * len(text))], names=["name", "text", "added", "node", "open"])

    def move(batches):
        low = (1 << (2 * k)) - 1
        for batch in batches:
            names, texts, added, nodes, path = [c.to_pylist() for c in batch.columns]
            codes = np.concatenate([np.zeros(0, np.int64), *canonical_codes(batch.column(1), k)]).tolist()
            out, at = [], 0
            for name, text, n, node, p in zip(names, texts, added, nodes, path):
                have, at = at, at + len(text) - k + 1
                if p is None:
                    out.append((text, n, node, False))
                    continue
                passed, new, going = set(codes[have:at]), [], True
                for i in range((p.bit_length() - 1) // 2 - 1, -1, -1):
                    base = (p >> (2 * i)) & 3
                    after = ((node << 2) | base) & low
                    canon = min(after, _mirror(after, k))
                    if n + len(new) >= reach or canon in passed:
                        going = False
                        break
                    passed.add(canon)
                    new.append("ACGT"[base])
                    node = after
                n += len(new)
                out.append((text + "".join(new), n, node, going and n < reach))
            if out:
                text, n, node, going = zip(*out)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), pa.array(n, pa.int32()), pa.array(node, pa.int64()), pa.array(going)], names=["name", "text", "added", "node", "open"])

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    moved, ended, table = keep(rows.select(F.col("name").cast("long").alias("name"), "text").mapInArrow(start, schema), "walk"), [], tables[0]
    while True:
        ended.append(moved.filter("not open").select("name", "text"))
        walking = moved.filter("open").select("name", "text", "added", "node")
        n = walking.count()
        if not n:
            break
        steps = table
        if n <= FEW:
            steps = table.join(F.broadcast(walking.select("node").distinct()), "node")  # FEW numbers at most
        moved = keep(walking.join(steps.hint("merge"), "node", "left").select("name", "text", "added", "node", "path").repartition(tasks).mapInArrow(move, schema), "walk")
        table = tables[1]
    out = ended[0]
    for e in ended[1:]:
        out = out.unionByName(e)
    return out


def _mirror(code: int, k: int) -> int:
    """The other strand of a k-mer's code, up to 32 bases: pairs of bits turned round."""
    x = ~code & ((1 << (2 * k)) - 1)
    x = (x & 0x3333333333333333) << 2 | (x >> 2) & 0x3333333333333333
    x = (x & 0x0F0F0F0F0F0F0F0F) << 4 | (x >> 4) & 0x0F0F0F0F0F0F0F0F
    return int.from_bytes(x.to_bytes(8, "little"), "big") >> (64 - 2 * k)


def _both_ways(rows: DataFrame, tables: tuple[DataFrame, DataFrame], k: int, reach: int) -> DataFrame:
    """(name, text) walked on to the right and then to the left, which is the mirrored text's right."""
    for _ in range(2):
        rows = _walk_right(rows, tables, k, reach).select("name", S.reverse_complement("text").alias("text"))
    return rows


def _held(rows: DataFrame, k: int) -> DataFrame:
    """(rank, code): the canonical k-mers of texts."""

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 1 << 10):
                some = batch.slice(low, 1 << 10)
                code = np.concatenate([np.zeros(0, np.int64), *canonical_codes(some.column(1), k)])
                rank = np.repeat(some.column(0).to_numpy(), np.diff(strings(some.column(1))[1]) - k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(rank), pa.array(code)], names=["rank", "code"])

    return rows.mapInArrow(run, "rank long, code long")


def _code(kmer):
    return F.conv(F.translate(kmer, S.BASES, "0123"), 4, 10).cast("long")


def templates(counts: DataFrame, k: int, shortest: int, least: int = 3, reach: int = 5000, most: int = 50_000) -> DataFrame:
    """(contig_id, sequence): walks of at least ``shortest`` bases, from seeds in the order of their counts.

    A seed that an earlier template holds is left out, and after ``most`` templates the rest, as the rule is sequential: so seeds
    walk in growing batches of ranks, until ``most`` templates are found or no seed is left.  The walks of a batch do not
    depend on each other; each round takes every seed whose k-mer no earlier open walk holds, and closes the seeds that the taken
    ones hold, until no seed of the batch is open.
    """
    if k > 31:
        raise ValueError("templates take k up to 31")
    ranked = number(counts.filter(F.col("count") >= least), [F.col("count").desc(), F.col("kmer")], "rank", ["kmer"])
    ranked = keep(ranked.select(F.col("rank").cast("long").alias("rank"), "kmer", _code("kmer").alias("code")), "ranked")
    total, tables = ranked.count(), paths(counts, k)
    low, size, taken, n = 0, BATCH, None, 0
    while taken is None or (low < total and n < most):
        batch = ranked.filter(F.col("rank").between(low, low + size - 1))
        if taken is not None:
            batch = batch.join(_held(taken.select("rank", "text"), k).select("code").distinct(), "code", "left_anti")
        walked = _both_ways(batch.select(F.col("rank").alias("name"), F.col("kmer").alias("text")), tables, k, reach).filter(F.length("text") >= shortest)
        open_ = keep(walked.select(F.col("name").alias("rank"), "text").join(batch.select("rank", "code").hint("merge"), "rank"), "open")
        while not open_.isEmpty():
            first = _held(open_.select("rank", "text"), k).groupBy("code").agg(F.min("rank").alias("first"))
            now = keep(open_.join(first.hint("merge"), "code").filter("first = rank").select("rank", "text"), "taken")
            taken = now if taken is None else taken.unionByName(now)
            by = _held(now, k).groupBy("code").agg(F.min("rank").alias("by"))
            # a seed that still waits for an earlier walk is not closed by a later one
            open_ = keep(open_.join(by.hint("merge"), "code", "left").filter("by is null or by > rank").select("rank", "text", "code"), "open")
        if taken is None:
            taken = open_.select("rank", "text")
        n = taken.count()
        low, size = low + size, 64 * size
    return number(taken.orderBy("rank").limit(most).withColumnRenamed("text", "sequence"), [F.col("rank")], "contig_id", ["sequence"]).select("contig_id", "sequence")


def extend_tips(templates_: DataFrame, counts: DataFrame, k: int, reach: int = 500) -> DataFrame:
    """Templates of (contig_id, sequence), both ends walked on over the whole k-mer table by the same rule."""
    rows = _both_ways(templates_.select(F.col("contig_id").alias("name"), F.col("sequence").alias("text")), paths(counts, k), k, reach)
    return rows.select(F.col("name").alias("contig_id"), F.col("text").alias("sequence"))

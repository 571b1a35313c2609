"""Properties of operators that SQL can't express."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import assembly, clusters, entropy, kmers, pairs, reorder, tensors
from strandlake.sources import fastq
from strandlake.sources import reads as R

FLIP = str.maketrans("ACGT", "TGCA")


def canon(s):
    return min(s, s.translate(FLIP)[::-1])


@pytest.fixture(scope="module")
def reads(spark, sf_dir):
    return R.derived_reads(spark, sf_dir, mutated=True)


def test_unitigs_spell_every_kmer_once(spark):
    text = "ACGTTGCATGGACCATTAGC"
    df = spark.createDataFrame([(0, text), (1, text[:9] + "TTTTGACA"), (2, "GATTACAGATTACAGATT")], "read_idx long, sequence string")
    counts = kmers.count_kmers(df, 5)
    want = {r.kmer for r in counts.collect()}
    spelled = [canon(r.sequence[i : i + 5]) for r in assembly.unitigs(counts, 5).collect() for i in range(len(r.sequence) - 4)]
    assert sorted(spelled) == sorted(want)


def test_greedy_contigs_hold_their_reads(spark):
    text = "ACGGTCATTGCAGTACCGATGACGTTAGCATCGGATTACAGTACGATCGATTACGATCAGCATCGAACCGGTTAACGTCA"
    rows = [(k, text[9 * k : 9 * k + 44], 0) for k in range(4)] + [(9, "T" * 40, 9)]
    df = spark.createDataFrame(rows, "read_idx long, sequence string, label long")
    got = {r.contig_id: r for r in assembly.greedy_contigs(df.drop("label"), df.select("read_idx", "label")).collect()}
    assert got[0].sequence == text[: 9 * 3 + 44] and got[0].reads == [0, 1, 2, 3] and got[9].reads == [9]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (100, 102)], "a long, b long")
    got = {r.read_idx: r.label for r in clusters.components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys((100, 101, 102), 100)}


@pytest.mark.parametrize("strategy", sorted(reorder.STRATEGIES))
def test_orders_are_bijections(reads, strategy):
    rows = reorder.by_strategy(reads, strategy, "sequence", 400)
    one = rows.agg(F.count("*").alias("n"), F.count_distinct("new_pos").alias("d"), F.min("new_pos").alias("low"), F.max("new_pos").alias("high")).first()
    assert one.n == one.d == one.high + 1 and one.low == 0
    assert rows.filter(F.floor(F.col("new_pos") / 400) != F.col("chunk_id")).isEmpty()


def test_global_order_is_sorted(reads):
    from strandlake.functions import sequence as S

    rows = reorder.similarity_global(reads, 4).select("read_idx", S.min_syncmer("sequence").alias("s")).collect()
    keys = [(r.s is None, (r.s["hash"], r.s.pos) if r.s else (0, 0)) for r in rows]
    assert keys == sorted(keys)


def test_pairs(spark):
    first = spark.createDataFrame([(0, "@a/1", "AC"), (1, "@b/1", "GT")], "read_idx long, id string, sequence string")
    second = spark.createDataFrame([(0, "@a/2", "TT"), (1, "@b/2", "GG")], "read_idx long, id string, sequence string")
    assert [(r.read_idx, r.mate_idx) for r in pairs.mates(first, second).orderBy("read_idx").collect()] == [(0, 2), (1, 3)]


def test_codebook(spark, reads):
    book = pairs.quality_codebook(pairs.quality_transitions(R.bases(reads, context=True)).filter("pos < 3"), 1.0)
    assert ((book["high"] - book["low"]).between(0, 1)).all() and book["ratio"].between(0, 1).all()
    values, loss = pairs._quantizer(np.array([0.25, 0.25, 0, 0, 0.25, 0.25]), 2)
    assert values[0] == values[1] and values[4] == values[5] and loss < 0.6


def test_quantized_reads(spark, reads):
    """Outputs are values of the book, reruns agree, and one state a column leaves one score."""
    transitions = pairs.quality_transitions(R.bases(reads, context=True))
    book = pairs.quality_codebook(transitions, 1.0)
    got = {x.read_idx: x.quality for x in pairs.quantize_reads(reads, book).collect()}
    assert got == {x.read_idx: x.quality for x in pairs.quantize_reads(reads.repartition(3), book).collect()}
    plain = {x.read_idx: x.quality for x in reads.collect()}
    assert all(len(got[i]) == len(plain[i]) for i in plain)
    first = book[(book["pos"] == 0) & (book["before"] == 0)].iloc[0]
    assert {ord(q[0]) - 33 for q in got.values()} <= set(first["low_values"]) | set(first["high_values"])
    flat = pairs.quantize_reads(reads, pairs.quality_codebook(transitions, 0.0)).collect()
    assert len({x.quality for x in flat}) == 1


def test_tensors(reads):
    energy = tensors.svd_ranks(reads, 64)
    assert energy[0.9] <= energy[0.95] <= energy[0.99]
    r = np.random.default_rng(0)
    t = np.einsum("i,j,k->ijk", r.random(6), r.random(7), r.random(5))
    assert np.allclose(tensors.cp(t, 1), t, atol=1e-6) and np.allclose(tensors.tucker(t, (1, 1, 1)), t)


def test_long_reads(spark):
    df = spark.createDataFrame([(0, "@a", "ACGTACG", "IIIIIII"), (1, "@b", "", "")], R.READS)
    assert [(r.read_idx, r.part, r.sequence, r.quality) for r in R.split_long(df, 3).orderBy("read_idx", "part").collect()] == [(0, 0, "ACG", "III"), (0, 1, "TAC", "III"), (0, 2, "G", "I"), (1, 0, "", "")]
    with pytest.raises(Exception, match="longer"):
        pairs.preprocess(df, longest=5).collect()


def test_decompositions_of_all_reads(spark):
    r = np.random.default_rng(6)
    rows = [(i, "".join(r.choice(list("ACGTN"), 12)), "".join(chr(33 + q) for q in r.integers(0, 41, 12))) for i in range(2500)]
    reads = spark.createDataFrame(rows, "read_idx long, sequence string, quality string")
    got = tensors.decompositions(reads, 12).set_index("method")
    assert list(got.index) == ["cp5", "cp10", "cp20", "cp50", "tucker"]
    t = tensors.tensor(reads.toPandas(), 12)
    for method, approx in (("cp5", tensors.cp(t, 5)), ("cp10", tensors.cp(t, 10)), ("tucker", tensors.tucker(t, (50, 12, 5)))):
        for key, value in tensors.quality_of(t, approx).items():
            assert abs(got.loc[method, key] - value) < 1e-4, (method, key)


def genome_counts(spark, k):
    """k-mer counts of reads with errors from a text with a repeat, both strands."""
    r = random.Random(1)
    text = "".join(r.choice("ACGT") for _ in range(300))
    text += text[40:90] + "".join(r.choice("ACGT") for _ in range(100))
    rows = []
    for i in range(400):
        at = r.randrange(len(text) - 40)
        s = text[at : at + 40]
        if r.random() < 0.3:
            j = r.randrange(40)
            s = s[:j] + r.choice("ACGT") + s[j + 1 :]
        rows.append((i, s if r.random() < 0.5 else s.translate(FLIP)[::-1]))
    return kmers.count_kmers(spark.createDataFrame(rows, "read_idx long, sequence string"), k)


def brute_walk(have, node, passed, reach):
    """Bases added to the right."""
    out = ""
    while len(out) < reach:
        best = max(((have.get(canon(node[1:] + b), 0), -i, b) for i, b in enumerate("ACGT")))
        after = node[1:] + best[2]
        if not best[0] or canon(after) in passed:
            break
        passed.add(canon(after))
        out += best[2]
        node = after
    return out


def test_templates_against_walking_one_by_one(spark):
    k, shortest = 9, 30
    counts = genome_counts(spark, k)
    have = {x.kmer: x["count"] for x in counts.collect()}
    used, want = set(), []
    for seed in sorted((s for s, n in have.items() if n >= 3), key=lambda s: (-have[s], s)):
        if seed in used:
            continue
        passed = {seed}
        right = brute_walk(have, seed, passed, 200)
        left = brute_walk(have, seed.translate(FLIP)[::-1], passed, 200)
        text = left.translate(FLIP)[::-1] + seed + right
        if len(text) >= shortest:
            want.append(text)
            used |= {canon(text[i : i + k]) for i in range(len(text) - k + 1)}
    got = sorted(assembly.templates(counts, k, shortest, reach=200).collect(), key=lambda x: x.contig_id)
    assert [x.sequence for x in got] == want and [x.contig_id for x in got] == list(range(len(want))) and len(want) > 3
    # tips: templates of the frequent k-mers walk on over all of them
    frequent = counts.filter("count >= 4")
    short = assembly.templates(frequent, k, shortest, reach=200).collect()
    longer = {x.contig_id: x.sequence for x in assembly.extend_tips(spark.createDataFrame(short), counts, k, 50).collect()}
    for x in short:
        passed = {canon(x.sequence[i : i + k]) for i in range(len(x.sequence) - k + 1)}
        right = brute_walk(have, x.sequence[-k:], passed, 50)
        left = brute_walk(have, x.sequence[:k].translate(FLIP)[::-1], passed, 50)
        assert longer[x.contig_id] == left.translate(FLIP)[::-1] + x.sequence + right


def test_global_numbers(spark):
    r = random.Random(4)
    rows = [(i, r.choice("abc")) for i in range(500)]
    got = reorder.number(spark.createDataFrame(rows, "i long, c string").repartition(7), [F.col("c").desc(), F.col("i")], "place", ["i"]).collect()
    order = sorted(rows, key=lambda x: (-ord(x[1]), x[0]))
    assert sorted((x.place, x.i) for x in got) == [(k, i) for k, (i, _) in enumerate(order)]


def test_log_gamma(spark):
    xs = [0.25, 0.5, 1.0, 2.0, 3.5, 10.0, 41.0, 1e4, 1e9]
    got = [x.g for x in spark.createDataFrame([(x,) for x in xs], "x double").select(entropy.log_gamma(F.col("x")).alias("g")).collect()]
    assert np.allclose(got, [math.lgamma(x) for x in xs], rtol=1e-12, atol=1e-9)


@pytest.mark.parametrize("up", [False, True])
def test_halving_cost_step_by_step(spark, up):
    r = random.Random(5)
    rows = [(i, p, r.choice("xy"), r.choice([0, 0, 0, 1, 2])) for i in range(60) for p in range(9)]
    bits = 0.0
    models = {}
    for i, p, c, s in rows:
        counts = models.setdefault((i // 25, c), [2] * 4)
        bits -= math.log2(counts[s] / sum(counts))
        counts[s] += 3
        if sum(counts) >= 50:
            counts[:] = [(n + 1) // 2 if up else max(n >> 1, 1) for n in counts]
    df = spark.createDataFrame(rows, "read_idx long, pos int, c string, s int")
    got = entropy.halving_cost(df, ["c"], "s", 4, 50, 25, prior=2, step=3, round_up=up).first()
    assert got.n == len(rows) and abs(got.bits - bits) < 1e-6
    free = entropy.halving_cost(df, ["c"], "s", 4, 10**6, 25, prior=2, step=3).first()
    blocks = [entropy.adaptive_cost(df.filter(f"floor(read_idx / 25) = {b}"), ["c"], "s", 4, prior=2, step=3).first().bits for b in range(3)]
    assert abs(free.bits - sum(blocks)) < 1e-6
    parts = entropy.adaptive_cost_by_block(df, ["c"], "s", 4, 25, prior=2, step=3).agg(F.sum("bits").alias("b")).first().b
    assert abs(parts - entropy.adaptive_cost(df, ["c"], "s", 4, prior=2, step=3).first().bits) < 1e-6


def test_context_columns(spark):
    df = spark.createDataFrame([(1, "ACGT", "!5I#"), (2, "N", "I"), (3, "", ""), (4, "AC", None)], "read_idx long, sequence string, quality string")
    got = [tuple(x) for x in R.bases(df, context=True, following=1).select("read_idx", "pos", "base", "phred", "q1", "q2", "b1", "b2", "b3", "n1", "next1").orderBy("read_idx", "pos").collect()]
    assert got[:5] == [
        (1, 0, "A", 0, 0, 0, "N", "N", "N", "C", 20), (1, 1, "C", 20, 0, 0, "A", "N", "N", "G", 40), (1, 2, "G", 40, 20, 0, "C", "A", "N", "T", 2),
        (1, 3, "T", 2, 40, 20, "G", "C", "A", "N", None), (2, 0, "N", 40, 0, 0, "N", "N", "N", "N", None),
    ]
    assert [x[:4] for x in got[5:]] == [(4, 0, "A", None), (4, 1, "C", None)]


def test_records_across_blocks(spark, tmp_path):
    """Blocks of 64 bytes cut records anywhere."""
    text = "".join(f"@r{i}\n{'ACGT' * (i % 5)}\n+\n{'IIII' * (i % 5)}\n" for i in range(300))
    (tmp_path / "a.fastq").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = fastq.read_fastq(spark, str(tmp_path / "a.fastq")).orderBy("read_idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(x.read_idx, x.id, x.sequence) for x in got] == [(i, f"@r{i}", "ACGT" * (i % 5)) for i in range(300)]


def test_gzip_levels_differ(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, f"@r{i}", "".join(r.choice("ACGT") for _ in range(100)), "".join(r.choice("!5I#") for _ in range(100))) for i in range(2000)]
    df = spark.createDataFrame(rows, "read_idx long, id string, sequence string, quality string")
    sizes = []
    for level in (1, 3, 6, 9):
        fastq.write_fastq(df, str(tmp_path / str(level)), compress=True, level=level, single_file=True)
        sizes.append(sum(f.stat().st_size for f in (tmp_path / str(level)).glob("part-*")))
    assert len(set(sizes)) >= 3 and sizes == sorted(sizes, reverse=True)


def test_components_of_random_graphs(spark):
    r = random.Random(8)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(1000 + r.randrange(9), 1000 + i) for i in range(500)] + [(-5, 1 << 62), (7000, 7000)]
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= (label[a], label[b]) != (low, low)
            label[a] = label[b] = low
    for last in (1 << 20, 20):  # joined in one task from the second round on, and round by round
        clusters.LAST_EDGES, before = last, clusters.LAST_EDGES
        try:
            got = {x.read_idx: x.label for x in clusters.components(spark.createDataFrame(edges, "a long, b long")).collect()}
        finally:
            clusters.LAST_EDGES = before
        assert got == label


def test_hubs_leave_no_edges_for_copies(spark):
    from strandlake.operators.kmers import minimizer_postings

    r = random.Random(9)
    a, b = ("".join(r.choice("ACGT") for _ in range(60)) for _ in range(2))
    reads = spark.createDataFrame([(i, a if i % 2 else b) for i in range(400)] + [(400, a[:40] + b[:40]), (401, "ACGTTGCA" * 2)], "read_idx long, sequence string")
    hubs = {x.read_idx: sorted(x.hubs) for x in clusters.hubs(minimizer_postings(reads, 15, 11)).collect()}
    assert hubs == {**{i: [i % 2] for i in range(400)}, 400: [0, 1]}
    got = {x.read_idx: x.label for x in clusters.clusters(reads, "all", 15, 11).collect()}
    assert got == {**dict.fromkeys(range(401), 0), 401: 401}


def brute_contigs(seqs, least, most, k, w):
    """Greedy contigs of one component, read by read over texts."""
    end, lists, unused, out = len(next(iter(seqs.values()))), {}, dict.fromkeys(seqs), []
    flip = lambda s: s.translate(FLIP)[::-1]
    for i, s in seqs.items():
        for kmer, pos, forward in assembly._minimizers(s, k, w):
            lists.setdefault(kmer, []).append((i, pos, forward))
    for seed in seqs:
        if seed not in unused:
            continue
        del unused[seed]
        contig, members = seqs[seed], [seed]
        for right in (True, False):
            while True:
                found, region = None, contig[-end:] if right else contig[:end]
                for kmer, pos, forward in assembly._minimizers(region, k, w):
                    for i, at, same in reversed(lists.get(kmer, [])):
                        read = seqs[i] if same == forward else flip(seqs[i])
                        start = (len(contig) - len(region) if right else 0) + pos - (at if same == forward else len(read) - at - k)
                        overlap = len(contig) - start if right else len(read) + start
                        fits = start >= 0 and overlap < len(read) if right else start < 0 and overlap <= len(contig)
                        if i not in unused or not fits or overlap < least:
                            continue
                        d = sum(x != y for x, y in zip(contig[start:] if right else contig, read[:overlap] if right else read[-start:]))
                        if d <= most and (found is None or d < found[0]):
                            found = (d, i, read, len(read) - overlap)
                if not found:
                    break
                contig = contig + found[2][-found[3] :] if right else found[2][: found[3]] + contig
                members.append(found[1])
                del unused[found[1]]
        out.append((seed, contig, sorted(members)))
    return out


def test_greedy_contigs_stream_by_component(spark):
    r = random.Random(10)
    rows = []
    for label in range(0, 300, 30):
        genome = "".join(r.choice("ACGT") for _ in range(150))
        for i in range(r.choice([1, 4, 29])):
            at, n = r.randrange(100), r.choice([44, 44, 44, 50])
            s = list(genome[at : at + n])
            if r.random() < 0.4:
                s[r.randrange(len(s))] = r.choice("ACGTNa")
            s = "".join(s)
            rows.append((label + i, s.upper().translate(FLIP)[::-1] if r.random() < 0.3 else s, label))
    df = spark.createDataFrame(rows, "read_idx long, sequence string, label long")
    want = []
    for label in range(0, 300, 30):
        want += brute_contigs({i: s.upper() for i, s, at in rows if at == label}, 25, 4, 11, 5)
    contigs = assembly.greedy_contigs(df.drop("label"), df.select("read_idx", "label"), least=25, k=11, w=5)
    assert sorted((x.contig_id, x.sequence, x.reads) for x in contigs.collect()) == sorted(want) and max(len(m) for _, _, m in want) > 5
    assert "FlatMapGroups" not in contigs._jdf.queryExecution().toString()  # no Python call per component


def test_packed_paths_are_best_steps(spark):
    k = 9
    counts = genome_counts(spark, k)
    code = lambda s: int(s.translate(str.maketrans("ACGT", "0123")), 4)
    best = {code(x.node): code(x.next) for x in assembly.best_steps(counts, k).collect()}
    every, long_ = ({x.node: x.path for x in t.collect()} for t in assembly.paths(counts, k))
    assert set(every) == set(best) and set(long_) <= set(best)
    for table in (every, long_):
        for node, path in table.items():
            assert 4 <= path < 1 << 63
            for i in range((path.bit_length() - 1) // 2 - 1, -1, -1):
                node = best[node]
                assert node & 3 == (path >> (2 * i)) & 3
            assert node in long_ or node not in best  # a walk goes on where a path ends
    assert sum(p.bit_length() for p in long_.values()) > 16 * len(long_)
    assert all(assembly._mirror(code(s), k) == code(s.translate(FLIP)[::-1]) for s in ("ACGTTGCAA", "TTTTTTTTT", "GATTACAGA"))


def test_templates_in_batches(spark, monkeypatch):
    counts = genome_counts(spark, 9)
    take = lambda **o: sorted((x.contig_id, x.sequence) for x in assembly.templates(counts, 9, 14, reach=12, **o).collect())
    whole = take()
    monkeypatch.setattr(assembly, "BATCH", 5)
    assert take() == whole and len(whole) > 10
    begun, walk = [], assembly._both_ways
    monkeypatch.setattr(assembly, "_both_ways", lambda *a: begun.append(1) or walk(*a))
    assert take(most=1) == whole[:1] and len(begun) == 1  # no later seed walks

"""Rows packed by block: the same results as row by row, with little to shuffle."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import delta


def test_prediction_residual_is_carried_from_part_to_part(spark):
    rng = random.Random(3)
    rows = [(i, p, rng.choice([None, "x", "y"]), rng.randrange(4)) for i in range(60) for p in range(rng.randrange(1, 5))]
    counts, want = {}, {}
    for i, p, c, s in sorted(rows, key=lambda r: r[:2]):
        seen = counts.setdefault((i // 25, c), {})
        want[i, p] = s - (min(seen, key=lambda x: (-seen[x], x)) if seen else 0) + 128
        seen[s] = seen.get(s, 0) + 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "read_idx long, pos int, c string, phred int").repartition(3)
    got = delta.prediction_residual(df, ["c"], block=25, part=4).collect()
    assert {(r.read_idx, r.pos): r.residual for r in got} == want and len(got) == len(rows)
    assert delta.prediction_residual(df.limit(0), ["c"], block=25, part=4).count() == 0


def test_halving_cost_takes_contexts_of_a_block_together(spark):
    from strandlake.operators import entropy

    rng = random.Random(4)
    rows = [(i, p, rng.choice(["x", "y", None]), rng.randrange(3), rng.choice("ab")) for i in range(80) for p in range(6)]
    for limit, prior, step, up in ((9, 1, 1, True), (30, 2, 3, False), (10**6, 1, 1, False)):
        want = 0.0
        for key in {(i // 30, c, d) for i, p, c, d, s in rows}:
            counts = dict.fromkeys("abcd", prior)
            for *_, s in sorted(r for r in rows if (r[0] // 30, r[2], r[3]) == key):
                want -= np.log2(counts[s] / sum(counts.values()))
                counts[s] += step
                if sum(counts.values()) >= limit:
                    counts = {k: (v + 1) // 2 if up else max(v >> 1, 1) for k, v in counts.items()}
        df = spark.createDataFrame(rows, "read_idx long, pos int, c string, d int, s string").repartition(5)
        plan = entropy.halving_cost(df, ["c", "d"], "s", 4, limit, 30, prior, step, up)
        assert plan.first().n == len(rows) and plan.first().bits == pytest.approx(want)
        # only packed messages are dealt by block, not rows by block and context
        assert "SortMergeJoin" not in plan._jdf.queryExecution().executedPlan().toString()


def test_base_above_skips_shorter_reads(spark):
    from strandlake.operators import consensus

    rows = [(0, "ACGT"), (1, "TT"), (2, "GGGGG"), (3, ""), (10, "CA"), (11, "TTT")]
    got = {r.read_idx: r.up for r in consensus.above(spark.createDataFrame(rows, "read_idx long, sequence string").repartition(3), 10).collect()}
    assert got == {0: "SSSS", 1: "AC", 2: "TTGTS", 10: "SS", 11: "CAS"}


def _mod4(rows):
    """Steps and bases by read and place, column by column."""
    before, steps = {}, []
    for i, text in rows:
        steps.append("".join(str(("ACGT".index(c) - before.get(p, 0)) % 4) if c in "ACGT" else "N" for p, c in enumerate(text)))
        before.update((p, "ACGT".index(c)) for p, c in enumerate(text) if c in "ACGT")
    return steps


def test_mod4_steps_are_carried_from_block_to_block(spark):
    from strandlake.operators import consensus

    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("ACGTACGTNx") for _ in range(rng.choice([0, 1, 3, 9, 300 if i % 50 == 0 else 5])))) for i in range(-20, 150) if not 40 <= i < 63]
    rows += [(7, "ACG"), (7, "ACG"), (7, "TTTTT"), (30, "NN"), (500, "NNN"), (None, "CC"), (None, "G")]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, "".join(c if c in "ACGT" else "N" for c in r[1])))
    want = _mod4(rows)
    mixed = rng.sample(rows, len(rows))
    reads = spark.createDataFrame(mixed, "read_idx long, sequence string").repartition(5)
    for block in (8, 64, 16384):
        steps = consensus.mod4_delta(reads, block)
        key = lambda r: (r.read_idx is not None, r.read_idx or 0, r.place)
        assert [(r.read_idx, r.steps) for r in sorted(steps.collect(), key=key)] == [(i, s) for (i, _), s in zip(rows, want)]
        back = sorted(consensus.mod4_undelta(steps.repartition(3), block).collect(), key=key)
        assert [(r.read_idx, r.sequence) for r in back] == [(i, "".join(c if c in "ACGT" else "N" for c in s)) for i, s in rows]
    assert consensus.mod4_undelta(consensus.mod4_delta(reads.limit(0))).count() == 0


def test_previous_bases_are_carried_from_block_to_block(spark):
    from strandlake.operators import consensus

    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("ACGTNéx😀" if i > 60 else "ACGN") for _ in range(rng.choice([0, 1, 4, 9, 300 if i % 50 == 0 else 5])))) for i in range(-20, 150) if not 40 <= i < 63]
    rows += [(7, "ACG"), (7, "ACG"), (None, "CC"), (None, "CG")]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    before, want = {}, []
    for i, text in rows:
        want.append((i, "".join("0" if before.get(p) == c else c for p, c in enumerate(text))))
        before.update(enumerate(text))
    reads = spark.createDataFrame(rng.sample(rows, len(rows)), "read_idx long, sequence string").repartition(5)
    for block in (8, 16384):
        got = consensus.previous_base_delta(reads, block).collect()
        assert [(r.read_idx, r.deltas) for r in sorted(got, key=lambda r: (r.read_idx is not None, r.read_idx or 0, r.place))] == want


def test_column_deltas_shuffle_reads_not_bases(spark, sf_dir):
    from strandlake.plans import registry

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    for name in ("mx05_mod4_delta", "mx05_mod4_undelta", "mx06_previous_base_delta"):
        before = written()
        df = registry.queries()[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        # a row per base would be 90,000 records
        assert 0 < written() - before < 3000 < df.count() / 20

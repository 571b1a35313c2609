"""Candidate pairs and rolling consensus at sizes and shapes of their own."""

import random

from strandlake.operators import pairs


def test_match_candidates_meet_every_read_of_a_window(spark):
    # more than the 1,000 reads that a window once met, and a read that only an early one of them matches
    rng = random.Random(5)
    text = "".join(rng.choice("ACGT") for _ in range(44))
    late = "".join({"A": "C", "C": "G", "G": "T", "T": "A"}[c] for c in text[:12]) + text[12:]
    rows = [(0, text)] + [(i, late) for i in range(1, 1200)] + [(5000, text), (6000, "ACGT")]
    got = pairs.match_candidates(spark.createDataFrame(rows, "read_idx long, sequence string").repartition(4))
    found = {(r.a, r.b, r.is_rc, r["shift"], r.distance) for r in got.filter("a in (0, 5000) or b in (0, 5000)").collect()}
    assert found == {(0, 5000, False, 0, 0)}
    assert got.filter("b = 1199 and not is_rc and shift = 0").count() == 1198


def test_rolling_consensus_streams_over_slices(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([7, 8, 9]) if i % 3 else 1, "".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 3, 9, 700])))) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "read_idx long, chain long, sequence string")
    got = {r.read_idx: (r.consensus, r.distance) for r in pairs.rolling_consensus(df.select("read_idx", "sequence"), df.selectExpr("chain", "read_idx as rank", "read_idx")).collect()}
    counts, want = {}, {}
    for i, chain, text in sorted(rows):
        top = ""
        for p, c in enumerate(text):
            n = counts.setdefault((chain, p), dict.fromkeys("ACTG", 0))
            if c in n:
                n[c] += 1
            top += max(n, key=n.get)
        want[i] = (top, sum(a != b for a, b in zip(text, top)))
    assert got == want
    plan = pairs.rolling_consensus(df.select("read_idx", "sequence"), df.selectExpr("chain", "read_idx as rank", "read_idx"))
    assert "FlatMapGroupsInPandas" not in plan._jdf.queryExecution().executedPlan().toString()


def test_quantized_reads_of_odd_lengths(spark):
    """Columns at once give what one read after another gives, also for unknown outputs, long scores and no quality."""
    import numpy as np
    import pandas as pd

    book = pd.DataFrame(
        [(0, 0, 0.3, [2, 2, 5, 9], [1, 4, 4, 7, 8]), (1, 2, 0.5, [3, 3, 6], [2, 6, 6]), (1, 6, 0.1, [1, 7, 7], [0, 5, 9]), (2, 4, 0.9, [0, 1], [1, 0])],
        columns=["pos", "before", "ratio", "low_values", "high_values"],
    )
    texts = {5: "!#%", 6: None, 7: "", 8: "$$$$$$$$", 9: "~~", 10: "é%"}
    table = {}
    for r in book.itertuples():
        table.setdefault(r.pos, []).append(r)

    def one(i, quality):
        draw, before, out = np.random.default_rng([1, i]).random(len(quality)), 0, ""
        for pos, c in enumerate(quality):
            e = min(table[min(pos, 2)], key=lambda e: (abs(e.before - before), e.before))
            values = e.high_values if draw[pos] < e.ratio else e.low_values
            before = values[min(ord(c) - 33, len(values) - 1)]
            out += chr(33 + before)
        return out

    reads = spark.createDataFrame(list(texts.items()), "read_idx long, quality string")
    got = {r.read_idx: r.quality for r in pairs.quantize_reads(reads, book).collect()}
    assert got == {i: None if t is None else one(i, t) for i, t in texts.items()}


def test_quantizer_of_all_scores_is_quick():
    import time

    import numpy as np

    p = np.arange(1.0, 43) / np.arange(1.0, 43).sum()
    start = time.monotonic()
    for states in (2, 5, 9):
        values, loss = pairs._quantizer(p, states)
        assert len(set(values.tolist())) <= states and np.isclose(loss, (p * (np.arange(42) - values) ** 2).sum())
    assert time.monotonic() - start < 0.1

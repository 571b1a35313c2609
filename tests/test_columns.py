"""Small tables of columns and contexts are sent to the bases; the bases are not shuffled to them."""

from strandlake.operators import consensus, kmers
from strandlake.plans import registry
from strandlake.sources import reads as R


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _reads(spark):
    return spark.createDataFrame([(0, "ACGTN"), (1, "ACG"), (2, "TCGTA"), (3, "")], "read_idx long, sequence string")


def test_residual_sends_the_consensus(spark):
    rows = R.bases(_reads(spark), False).hint("shuffle_merge")
    assert "SortMergeJoin" not in _plan(consensus.residual(rows, consensus.column_consensus(rows)))


def test_ranks_are_sent(spark):
    assert "SortMergeJoin" not in _plan(kmers.rank_bases(_reads(spark).hint("shuffle_merge"), 2))
    rows = registry._before(_reads(spark), 4)
    assert {(r.read_idx, r.pos): r.context for r in rows.collect() if r.read_idx == 0} == {(0, p): "ACGTN"[max(0, p - 4) : p] for p in range(5)}
    got = consensus.rank_mixed_order(rows, 4)
    assert "collect_list" not in _plan(got)
    want = consensus.rank_mixed_order(R.bases(_reads(spark), False), 4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

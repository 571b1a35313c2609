"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of ``docs``.  Null texts count as empty, tables may be empty, and further columns
pass through.
"""

from __future__ import annotations

from strandlake.llm import exact, minhash, mixing, packing, toxicity
from strandlake.llm.common import documents, materialize


def drop_toxic(spark, docs, sf_dir):
    """Documents that the classifier calls toxic go.  It learns from the labelled documents of ``docs``."""
    model = toxicity.train(docs, documents(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_copies(spark, docs, sf_dir):
    """Of equal texts the row with the largest doc_id stays."""
    return exact.drop_copies(docs)


def drop_near_copies(spark, docs, sf_dir):
    """Of near duplicates (five-word shingles, similarity 0.8 or more) the smallest doc_id stays."""
    return minhash.drop_near_copies(docs, width=5, percent=80)


def mix_sources(spark, docs, sf_dir):
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mixing.mixed(docs)


def pack_tokens(spark, docs, sf_dir):
    """Pieces of token windows."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

#: Toxicity and packing can't be put in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, "stage")
    return docs

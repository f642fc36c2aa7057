"""A corpus made ready for training: five filtering and encoding stages over ``documents``.

Every stage is a written table that the next one reads. STAGES lists (name, function of (spark, docs, folder)).
"""

from __future__ import annotations

from duelframe.llm import decontaminate, exact_dedup, minhash_dedup, toxicity, wfst_tokens
from duelframe.llm.catalog import table
from duelframe.llm.documents_queries import model_bytes, toxicity_model
from duelframe.llm.staging import stage
from duelframe.session import ship_package


def toxicity_stage(spark, docs, folder):
    """Rejects documents that score 0.5 or more. The model learns from the labelled rows of this stage's input."""
    ship_package(spark)
    return toxicity.drop_toxic(docs, toxicity_model(spark, folder, docs))


def exact_stage(spark, docs, folder):
    """Keeps the smallest id of each group of equal texts."""
    ship_package(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark, docs, folder):
    """Keeps the smallest id of each group linked by 5-word shingles with a similarity of 0.8 or more."""
    ship_package(spark)
    return minhash_dedup.drop_near_duplicates(docs)


def benchmark_stage(spark, docs, folder):
    """Drops documents that contain a benchmark item."""
    ship_package(spark)
    return decontaminate.drop_contaminated(docs, table(spark, folder, "benchmark"))


def encode_stage(spark, docs, folder):
    """Piece ids of every remaining document, with a check that they decode to the same text."""
    ship_package(spark)
    return wfst_tokens.encode(docs, model_bytes())


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("sentencepiece", encode_stage),
]

ORACLE_SQL = None  # learned scores, near duplicates and piece ids are beyond SQL; tests compare with brute force


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline of four stages; each works on all that its predecessor kept.

toxicity: documents with a score of 0.5 or more go. near_duplicates: of each group of documents that links of word
shingles (five words, similarity 0.8 or more) hold together, one stays. secrets: every secret span is masked. packing:
what is left is packed into sequences of at most 4096 tokens.

Edge cases are those of the operators: null and empty texts are clean, link with nothing and hold no secret.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import lean, load, written
from tessera.llm.jaccard_join import keep_one
from tessera.llm.packing import pack
from tessera.llm.secrets import mask_secrets
from tessera.llm.toxicity import fit, not_toxic, training_rows


#: Stages follow each other in the same workers and executors, which keep what a stage before has taken.
BATCH = 4 << 20


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark, BATCH)
    model = fit(training_rows(docs, load(spark, sf_dir, "labels")))
    return not_toxic(docs, *model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark, BATCH)
    return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark, BATCH)
    return mask_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark, BATCH)
    return pack(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]

#: No SQL: a trained classifier, a merge-based tokenizer and a number-partitioning heuristic aren't expressible.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

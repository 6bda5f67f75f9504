"""A training corpus from raw documents in five stages, each of them one operator of ``factloom.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next one.  All but the last return the columns of ``documents``; the last returns what is left, tokenised and decoded.
Edge cases (nulls, empty and repeated rows, empty tables, further columns) are defined by the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import decontaminate, exact_dedup, pieces, simhash, store, toxicity
from factloom.llm.queries import piece_model, table
from factloom.llm.store import Scratch


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fitted lexicon does not call toxic."""
    model = toxicity.fit(spark, docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(spark, docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (A-Z lower-cased), the one with the largest id."""
    return exact_dedup.drop_exact_copies(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the one with the smallest id."""
    return simhash.drop_near_copies(spark, docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.drop_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document left."""
    return pieces.round_trip(spark, docs, piece_model()).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("simhash", near), ("decontamination", benchmark), ("sentencepiece", tokens)]

#: The fitted lexicon, fingerprints and tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = store.written(spark)
        kept = scratch.keep(stage(spark, docs, sf_dir), name)
        # the stage's result is written, so its own tables have served
        store.clear(spark, [root for root in store.written(spark) if root not in before])
        if hasattr(docs, "_factloom_path"):
            scratch.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)

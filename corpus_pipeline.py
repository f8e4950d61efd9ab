"""A corpus pipeline of five stages, each written and read again before the next.

All but the last return the columns of documents, whatever else a table may hold beside them.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.llm.bpe import checked
from emberlake.llm.exact_dedup import drop_copies
from emberlake.llm.mixing import mixed
from emberlake.llm.ngram_join import one_of_each
from emberlake.llm.toxicity import drop_toxic
from emberlake.llm.workspace import Workspace

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the factorization machine holds for toxic go. Null and empty texts score as texts without words do; repeated rows go or stay together; rows without a doc_id are scored like all."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays, of rows that repeat it one. Null and empty texts are equal; null ids are below all others."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 over five-word shingles, the one with the smallest doc_id stays. Texts without words and rows without a doc_id link with nothing and stay."""
    return one_of_each(docs, n=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 1, 2, 3 in turn (null is the last source): documents repeat, are cut, or go, as their source's target asks; those without words go."""
    return mixed(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text (null: none), and whether they decode to it. Every row stays, repeated ones too."""
    done = checked(docs.select("doc_id", "lang", "source", "text"), RANKS, public_tokenizers.PATTERN)
    return done.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "decodes")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("byte_bpe", byte_bpe)]
#: SQL can't fit the machine of the first stage; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; an empty table gives an empty one."""
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        done = work.save(stage(spark, docs, sf_dir))
        if hasattr(docs, "_workspace_path"):
            work.drop(docs)
        docs = done
    return docs

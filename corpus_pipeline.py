"""A corpus pipeline: toxic documents, exact copies, near copies and benchmark passages go; the rest is tokenised.

Each stage gets what the one before kept, and returns the columns of documents; the last returns the
digests of the token ids. run() writes every stage to the shared folder as Parquet and reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from swathkit.llm import bloom_dedup, byte_bpe, decontaminate, queries, simhash_dedup, toxicity
from swathkit.llm.shared import materialize
from swathkit.sources.scratch import recorded, remove


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, queries.toxicity_model(spark, sf_dir))


def _exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bloom_dedup.exact_dedup(docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_first(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.token_digests(docs, queries.BPE_RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", _toxicity),
    ("exact_dedup", _exact_dedup),
    ("simhash_near_dedup", _near_dedup),
    ("benchmark_decontamination", _decontaminate),
    ("byte_bpe", _tokenise),
]

#: Neither the toxicity model nor the tokeniser can be said in SQL; tests compare with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Of the scratch tables, those of a stage go once its result is written, and results once the next one is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, stage in STAGES:
        with recorded() as made:
            docs = materialize(stage(spark, docs, sf_dir), name)
        remove(spark, [*before, *made[:-1]])
        before = made[-1:]
    return docs

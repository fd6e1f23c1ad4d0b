"""A training-data pipeline over ``documents``: five stages, each an operator of ``tidemark.llm``.

1. ``language_id`` drops texts in which no language can be recognised (null texts and those without a letter).
2. ``exact_dedup`` keeps one row of every group of equal texts, that of the smallest doc_id.
3. ``near_dedup`` keeps one document of every group linked by five-word Jaccard of 0.8 or more, that of the smallest
   doc_id: operator 6's byte-position index and count filter, with a signature long enough for that similarity.
4. ``mixing`` repeats and drops rows so that sources come near their target weights.
5. ``packing`` lays the token ids of what is left into sequences of the permitted lengths, one row a sequence.

Every stage is written as Parquet and read again as the next one's input; all but the last return the columns of
their input.  Nulls, empty tables and further columns are treated as the operators' texts say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.exact_dedup import deduplicated
from tidemark.llm.language_id import recognised
from tidemark.llm.mixing import mixed
from tidemark.llm.packing import pack
from tidemark.llm.shared import collecting, materialize, remove
from tidemark.llm.simhash import near_deduplicated


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return recognised(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_deduplicated(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: SQL has neither the suffix automata nor the hash of the shingles: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with collecting() as made:
            kept = stage(spark, docs, sf_dir)
        docs = materialize(kept, f"pipeline-{name}")
        remove(spark, made)  # the stage's own work tables
    return STAGES[-1][1](spark, docs, sf_dir)

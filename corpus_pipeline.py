"""A corpus pipeline: each stage takes (spark, docs, sf_dir) and its result is the next one's docs.

Stages take documents with nulls in any column, empty and very long texts, repeated rows and columns beyond
those of ``documents``; all but the last return the columns they got. What becomes of such rows is said in
the docstrings of the operators they call; an empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from relspark.llm.common import ensure_checkpoint_dir
from relspark.llm.decontaminate import drop_contaminated
from relspark.llm.mixing import mix_sources
from relspark.llm.ngram_join import keep_one
from relspark.llm.quality import drop_rejected, train
from relspark.llm.sharding import compact_into_shards


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranker scores below its cut go."""
    return drop_rejected(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 one document stays."""
    return keep_one(docs, n=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share too much with the benchmark go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated at random so that small sources weigh more."""
    return mix_sources(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents end in target-sized shards; adds the number of each one's shard."""
    return compact_into_shards(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix),
    ("sharding", shard),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs

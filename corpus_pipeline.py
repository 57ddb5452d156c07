"""A corpus from raw documents: toxic ones out, near copies out, benchmark leaks out, mixed, sharded.

``STAGES`` lists (name, function). A function takes (spark, docs, sf_dir) and returns a DataFrame;
all but the last return the columns of documents. ``run`` applies them one after the other and
writes what each returns as Parquet in the shared folder before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from regionloom.llm import decontamination, mixing, sharding, simhash, toxicity
from regionloom.session import shared_path

#: SQL has no XXH64, no model fit and no keyed permutation; a brute-force test stands in for it.
ORACLE_SQL = None


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score does not reject."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~toxicity.held_out())
    return toxicity.clean_documents(docs, model)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, the one with the smallest doc_id."""
    return simhash.one_per_group(docs)


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark, also with other numbers, names or units in them."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row per document and pass, texts cut to the drawn blocks."""
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its place there."""
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_copies),
    ("decontamination", remove_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

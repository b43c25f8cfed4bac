"""A training corpus in five stages: what can't be told to be a language goes, one of each near-duplicate group stays, secrets are
masked, sources are mixed to target weights, and the mix is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factlake.llm import jaccard, langid, mixing, packing, secrets
from factlake.llm.common import written
from factlake.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document that the mix takes twice is there twice; each shard is one partition, so one file, in the shard's order."""
    return mixing.mixed(docs, places=False)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Workers remember fewer words than packing alone lets them, since the stages before have used up memory."""
    return packing.packed(docs, tokenizer_path(), memo=250_000)


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("secret scans", secret_scan), ("mixing sources to target weights", mix), ("best-fit packing", pack)]

#: SQL can't express the network of the first stage; a test holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.split()[0].lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)

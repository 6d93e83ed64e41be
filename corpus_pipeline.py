"""A corpus pipeline: quality rules, near-duplicates, benchmark passages, mixing, sharding.

Every stage takes the documents that its predecessor kept and returns documents; the last adds
shard, slot and the sizes it was dealt by. Between stages rows are written to the shared folder,
so a lost executor costs a re-read.

Defined results: null and empty texts fail the quality rules, and texts of any length are worked
whole; rows without an id, and equal rows, are documents of their own until near-duplicates keeps
one of each group; columns beyond those of documents pass through every stage under their own
names, and names that a stage needs itself are made to differ from them; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oddity.llm import block_mixing, external_shuffle, hyperminhash_dedup, qgram_decontamination, quality_divergence
from oddity.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are near enough to a language's histograms."""
    return quality_divergence.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 0.8 or more on five-word shingles."""
    return hyperminhash_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs within its edit budget."""
    return qgram_decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix at the target weights: a row for each piece of a document in a block, once for every use."""
    return block_mixing.mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix dealt to shards, with a gapless slot in each."""
    placed, names = external_shuffle.external_shuffle(docs)
    return placed.drop(names["bucket"], names["grown"])


STAGES = [("quality rules", quality), ("near-duplicates", near_duplicates), ("decontamination", decontamination),
          ("mixing", mixing), ("sharding", sharding)]

#: Edit distances, hashed draws and the shuffle are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

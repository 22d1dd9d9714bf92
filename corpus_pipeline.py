"""The corpus pipeline: each stage calls one operator on what the stage before it kept.

Documents that no learned language describes go, then all but one of each class of near duplicates, then those that
hold a passage of the benchmark; the rest is mixed to target weights (a document comes once for every epoch that takes
it) and dealt into shards. ``run`` stores the documents between the stages, so a lost executor costs one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitlife.llm import decontaminate, jaccard, langid, mixing, sharding
from unitlife.llm.queries import DOMAIN, MIX
from unitlife.llm.shared import stored, table

SHARDS = 8
SHARE = (1, 1)  # of all tokens


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not rejected; the models learn from the labelled ones."""
    found = langid.identify(docs, langid.fit(docs))
    return found.filter(~F.col("rejected")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class."""
    return jaccard.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a test item; a whole item of a few words may stand in a clean one."""
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    leaked = F.exists("leaks", lambda leak: leak["equal"] >= decontaminate.MIN_WORDS)
    return found.filter(~leaked).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target proportions."""
    chosen = mixing.mix(docs.withColumn("domain", F.expr(DOMAIN)), ("domain", "lang", "source"), SHARE, MIX, seed=7)
    return chosen.select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("language identification", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

ORACLE_SQL = None  # language models and alignments are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to sharded training rows: five stages, each over all that the one before kept.

toxicity drops documents classified as toxic; near_duplicates keeps one document of each group of
near copies; decontamination drops documents that hold a benchmark passage; mixing repeats rows of
small sources up to its limit (every row stays at least once); sharding adds slot and shard.

Edge cases: documents with null or empty texts stay, as no stage finds anything in them; of repeated
rows one stays; a null id or source is a value like others; empty tables give an empty result; without
labels of both classes the toxicity stage drops nothing unless all labels are toxic; further columns
pass through, and must not be called score, predicted, copies, slot or shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchbench.llm import decontam, mixing, ngram_join, sharding, toxicity
from matchbench.llm.common import materialize, table
from matchbench.llm.queries import SHARDS, SLOTS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.annotate(docs, model).where("predicted = 0").drop("score", "predicted")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, mixing.MixSpec())


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(docs, ["doc_id"], SHARDS, SLOTS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: No SQL: a trained classifier decides in the first stage. tests/llm holds it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

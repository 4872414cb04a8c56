"""A training corpus from raw documents: filter, deduplicate, decontaminate, mix and shard.

``STAGES`` lists the steps; each takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next step's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import barlab
from barlab.llm import decontaminate, mixing, near_dups, quality, sharding
from barlab.llm.queries import table

cloudpickle.register_pickle_by_value(barlab)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that pass the base rules and the forest's threshold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    forest = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.passing(docs, forest)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of exact and near copies."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return near_dups.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as its source's target asks for."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return sharding.assign(docs, [1.0] * 24, [1.0] * 25)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

ORACLE_SQL = None  # trained threshold and sketches: tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows go through Parquet in the shared folder."""
    from uuid import uuid4

    from barlab.session import ensure_checkpoint_dir

    docs, folder = table(spark, sf_dir, "documents"), f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

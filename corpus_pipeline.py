"""From raw documents to a training mix, one operator a stage.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and
returns a DataFrame that ``run`` writes as Parquet and reads again for the next one. All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import decontaminate, simhash_dedup, source_mix, suffix_dedup, toxicity
from lexloom.llm.runtime import read_table, removed, shared_folder


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels"))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts alike by 0.8 or more: the smallest doc_id."""
    return simhash_dedup.keep_one(docs)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 200 bytes or more that occur again anywhere.

    All occurrences are cut alike. A document of which nothing is left goes; where text is
    cut, ``n_chars`` is counted anew.
    """
    return suffix_dedup.cut_repeats(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per copy taken, with its shard, its order there and its words."""
    return source_mix.mix(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("near_dedup", near_copies_out),
    ("suffix_dedup", repeats_out),
    ("decontamination", benchmark_out),
    ("mixing", to_weights),
]

#: SQL states neither the classifier nor the fingerprints' components.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each through a table in the shared folder.

    A stage's table goes once the next one is written; that of the last stage stays.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        at = os.path.join(folder, name)
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            removed(spark, before)
        before = at
    return docs

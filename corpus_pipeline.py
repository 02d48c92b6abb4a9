"""Corpus pipeline: STAGES in order, each over all documents that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobloom.llm import pipeline_stages as stages

STAGES = [
    ("quality rules", stages.quality_stage),
    ("n-gram Jaccard join", stages.near_duplicates_stage),
    ("suffix-array dedup", stages.repeats_stage),
    ("mixing sources to target weights", stages.mixing_stage),
    ("BPE encoding and decoding", stages.bpe_stage),
]

#: The near-duplicate join and the suffix-array stage cannot be expressed in SQL; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table documents; each result is written as Parquet and read again."""
    return stages.run(spark, sf_dir, STAGES)

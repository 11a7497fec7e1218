"""The corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark passages, source mix."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assayline.llm import stages
from assayline.llm.common import checkpoint_dir, clear_pins, remove, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", stages.drop_toxic),
    ("simhash_near_dedup", stages.one_of_each_group),
    ("substring_dedup", stages.cut_repeats),
    ("benchmark_decontamination", stages.drop_contaminated),
    ("mixing", stages.mix_sources),
]
#: Learned scores, sketches and draws are not SQL; the tests hold the run against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again by the next.

    What a stage kept on the way, and its predecessor's result, go when its own is written.
    """
    folder = f"{checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        clear_pins(spark)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs

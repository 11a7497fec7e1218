"""Stages of the corpus pipeline: each judges all documents that it is given and acts on what it finds.

A stage takes (spark, docs, sf_dir); all but the last return the columns of ``docs``.
Null and empty texts pass every stage (they are near-duplicates of each other, so one
of them stays), an empty table gives an empty one, and other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm import decontam, mixing, simhash, substring_dedup, toxicity
from assayline.llm.common import shielded, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Columns that stages look at; others pass through, whatever their names.
OWN = ("doc_id", "text", "source", "n_chars")


def guarded(stage: Stage) -> Stage:
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inner, restore = shielded(docs, OWN)
        return restore(stage(spark, inner, sf_dir))

    return run


@guarded
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that toxicity scoring does not reject."""
    scores = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), keep=tuple(docs.columns))
    return scores.where("predicted = 0").select(*docs.columns)


@guarded
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group.

    Rows without an id cannot be told apart by it, and stay; of rows that share the
    smallest id, all stay.
    """
    found = simhash.near_duplicates(docs)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti").select(*docs.columns)


@guarded
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; a text that loses nothing stays as it is, n_chars follows the text."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    done = substring_dedup.remove_repeats(docs, keep=others)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text").cast("string"))
    chars = {"n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in others else {}
    return done.withColumns({"text": text} | chars).select(*docs.columns)


@guarded
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which no twentieth or more is benchmark passages."""
    judged = decontam.judge_documents(docs, table(spark, sf_dir, "benchmark"), keep=tuple(docs.columns))
    return judged.where(~F.col("contaminated")).select(*docs.columns)


@guarded
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: one row per copy, with ``copy`` from 1 in place of any column of that name."""
    return mixing.mix(docs)

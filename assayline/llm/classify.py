"""What both text classifiers share: the bounded sample of labelled rows, training shards, scoring of all rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.common import map_texts, pin, remainder, unpin

#: Labelled rows that a model is fitted on at most (as expected size of a hash sample), and rows per shard.
SAMPLE_ROWS = 24_000
SHARD_ROWS = 6_000


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int = SAMPLE_ROWS, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """(text, label, shard) of labelled rows outside the held-out fold, and the number of shards.

    All such rows if they are at most ``rows``, else those whose hashed id falls below
    the fraction.  The sample's ids are bounded, so they are broadcast and no text
    moves but the sample's.  Rows with a null id, label or text teach nothing.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("_id").isNotNull() & (remainder(F.col("_id"), folds) != held_out)).distinct()
    n = known.count()
    picked = known.where(F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1 << 20)) < F.lit(int(min(1.0, rows / max(n, 1)) * (1 << 20))))
    shards = max(1, round(min(n, rows) / shard_rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("binary").alias("text")).where("text is not null")
    joined = texts.join(F.broadcast(picked), "_id")
    return joined.select("text", "label", F.pmod(F.xxhash64("_id", F.lit("shard")), F.lit(shards)).alias("shard"), F.xxhash64("_id", F.lit("order")).alias("turn")), shards


def shard_rows(group: pa.Table) -> tuple[list[bytes], np.ndarray]:
    """Texts and labels of a shard in an order that does not depend on how it arrived."""
    texts, labels, turns = group["text"].to_pylist(), group["label"].to_pylist(), group["turn"].to_pylist()
    order = sorted(range(len(texts)), key=lambda i: (turns[i], texts[i], labels[i]))
    return [texts[i] for i in order], np.array([labels[i] for i in order], np.int64)


def length(features: np.ndarray) -> float:
    """Length of a vector of distinct indicators; 1 if there are none."""
    return max(float(len(features)), 1.0) ** 0.5


def fitted(rows: DataFrame, fit: Callable[[list[bytes], np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Mean of the weights that ``fit`` learns on each shard, all shards at once; one sparse vector for each of the few shards reaches the driver."""

    def shard(group: pa.Table) -> pa.Table:
        w = fit(*shard_rows(group))
        at = np.flatnonzero(w)
        return pa.table({"shard": group["shard"].slice(0, 1).cast(pa.int64()), "at": pa.array([at.astype(np.int32).tobytes()], pa.binary()), "w": pa.array([w[at].astype(np.float32).tobytes()], pa.binary())})

    total, n = np.zeros(size), 0
    learned = pin(rows.groupBy("shard").applyInArrow(shard, "shard long, at binary, w binary"))
    for r in sorted(learned.collect(), key=lambda r: r["shard"]):
        total[np.frombuffer(r["at"], np.int32)] += np.frombuffer(r["w"], np.float32)
        n += 1
    unpin(learned)
    return total / max(n, 1)


def scored(docs: DataFrame, weights: np.ndarray, features: Callable[[bytes], np.ndarray], threshold: float, keep: tuple[str, ...], unit_length: bool = False) -> DataFrame:
    """The columns of ``keep``, score (logistic of the weights of the text's distinct features and of the last weight, the bias) and predicted."""
    at = np.flatnonzero(weights).astype(np.int32)
    shared = docs.sparkSession.sparkContext.broadcast((len(weights), at, weights[at].astype(np.float32)))

    def judge(texts: list[bytes]) -> dict[str, pa.Array]:
        size, where, values = shared.value
        w = np.zeros(size)
        w[where] = values
        some = w != 0
        margin = np.empty(len(texts))
        for i, t in enumerate(texts):
            f = features(t)
            if unit_length:
                f = np.unique(f)
                margin[i] = w[f].sum() / length(f) + w[-1]
            else:
                margin[i] = w[np.unique(f[some[f]])].sum() + w[-1]
        score = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
        return {"score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))}

    return map_texts(docs, judge, "score double, predicted int", keep=keep)


def with_fold(scores: DataFrame, folds: int, held_out: int) -> DataFrame:
    """``scores`` with held_out: whether the row's crc32 remainder is the held-out one; false for a null id."""
    return scores.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), folds) == held_out, F.lit(False)))

"""What the operators of this subpackage share: input columns, words, batches, labels.

Words are split on ASCII white space only (``bytes.split()``: space and 0x09-0x0D)
and lower-casing touches A-Z only (``bytes.lower()``), so a text is always the same
words in Spark, in Python and in the tests.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from assayline.session import checkpoint_dir

#: A word, as a Java regular expression.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one Python task holds at a time.
BATCH_BYTES = 8 << 20
#: Bytes of requests that one bucket gathers.
BUCKET_BYTES = 8 << 20
NULL_ID = np.int64(-(2**63))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders of pinned frames that are still there, by application.
_PINNED: dict[str, list[str]] = {}


def pin(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read again.

    So it outlives executors, is computed once, and the plan knows its real size: a
    checkpointed frame keeps its *estimated* one, which joins multiply round by round.
    The folder stays until :func:`unpin`, :func:`clear_pins` or the end of the driver.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/pins/{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    _PINNED.setdefault(spark.sparkContext.applicationId, []).append(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._pinned = path
    return kept


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder of any file system that Spark can reach."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def unpin(*frames: DataFrame) -> None:
    """Remove the folders of pinned ``frames`` that nothing reads any more."""
    for df in frames:
        pinned = _PINNED.get(df.sparkSession.sparkContext.applicationId, [])
        if (path := getattr(df, "_pinned", None)) in pinned:
            pinned.remove(path)
            remove(df.sparkSession, path)


def clear_pins(spark: SparkSession) -> None:
    """Remove all pinned folders of this application: for callers that have written every result that they asked for."""
    pinned = _PINNED.get(spark.sparkContext.applicationId, [])
    while pinned:
        remove(spark, pinned.pop())


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def shielded(docs: DataFrame, own: tuple[str, ...]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with every column but ``own`` renamed out of the way, and what gives the names back.

    A restored name that the result has for a column of its own is left to the result.
    """
    names = {f"_extra{i}": c for i, c in enumerate(docs.columns) if c not in own}
    moved = {c: n for n, c in names.items()}

    def restore(result: DataFrame) -> DataFrame:
        taken = {c for c in result.columns if c not in names}
        keep = [c for c in result.columns if names.get(c) not in taken]
        return result.select(*keep).toDF(*[names.get(c, c) for c in keep])

    return docs.toDF(*[moved.get(c, c) for c in docs.columns]), restore


def batches(docs: DataFrame, doc_id: str, text: str, keep: tuple[str, ...] = (), batch_bytes: int = BATCH_BYTES) -> tuple[DataFrame, int]:
    """``docs`` as (doc_id, text as bytes, kept columns, _batch), dealt out by ``_batch``; and the bytes of all texts.

    A batch is the documents whose hashed id falls into it, about ``batch_bytes`` of
    text.  What a batch holds depends on the rows alone, not on files, partitions
    or retries, so a second pass meets the same batch again.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text)) + 64).alias("b"), F.count(F.lit(1)).alias("n")).first()
    total = int(size["b"] or 0) + 64 * int(size["n"])
    n = max(1, math.ceil(total / batch_bytes))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).cast("binary").alias("text"),
        *[F.col(c) for c in keep],
        F.pmod(F.xxhash64(F.col(doc_id).cast("long"), F.lit("batch")), F.lit(n)).alias("_batch"),
    )
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, "_batch"), total


def ordered(rows: pa.Table) -> tuple[pa.Table, np.ndarray, list[bytes]]:
    """The rows of a batch by (doc_id, text), nulls first; their ids (null: the smallest) and texts (null: empty)."""
    ids, texts = rows["doc_id"].to_pylist(), [t or b"" for t in rows["text"].to_pylist()]
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
    keys = np.array([NULL_ID if ids[i] is None else ids[i] for i in order], np.int64)
    return rows.take(pa.array(order, pa.int64())), keys, [texts[i] for i in order]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """``h`` with every bit depending on every other (a copy)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


#: Multiplier of the rolling polynomial; odd, so it has an inverse modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def rolling(h: np.ndarray, length: int) -> np.ndarray:
    """Rabin-Karp hash, modulo 2**64, of every run of ``length`` values of ``h``; all windows in a few vector operations.

    With prefix sums of ``h[i] * base**-i`` a window is a difference, shifted back by ``base**i``.
    """
    n = len(h) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    down = np.multiply.accumulate(np.full(len(h), _INVERSE, np.uint64))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * down, out=sums[1:])
    up = np.multiply.accumulate(np.full(n, _BASE, np.uint64))
    return mixed((sums[length:] - sums[:n]) * up)


def split_by(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order that groups entries by bucket, and the ``n + 1`` bounds of the groups."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def runs(x: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, np.int64)


#: A-Z to a-z; every other ASCII byte but digits and letters to a space.
ALNUM = bytes((c if 48 <= c < 58 or 97 <= c < 123 or c > 127 else c + 32 if 65 <= c < 91 else 32) for c in range(256))


def map_texts(
    docs: DataFrame, fn: Callable[[list[bytes]], dict[str, pa.Array]], schema: str, text: str = "text", keep: tuple[str, ...] = (), chunk_bytes: int = 4 << 20
) -> DataFrame:
    """The ``keep`` columns of every row and the columns that ``fn`` makes of the texts (null: empty), some megabytes of text at a time."""
    types = dict(docs.dtypes)
    rows = docs.select(F.col(text).cast("binary").alias("_text"), *[F.col(f"`{c}`") for c in keep])

    def each(record_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in record_batches:
            sizes = np.cumsum([0, *(len(t) if (t := x.as_buffer()) is not None else 0 for x in batch.column("_text"))])
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + chunk_bytes, "right")) - 1)
                part = batch.slice(at, to - at)
                made = fn([t or b"" for t in part.column("_text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made.values()], [*keep, *made])
                at = to

    return rows.mapInArrow(each, ", ".join([*(f"`{c}` {types[c]}" for c in keep), schema]))

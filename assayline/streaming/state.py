"""Keyed state of streams: Spark's state store for row-wise decisions, a bucketed table for batch bodies."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone
from itertools import islice
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: A state store that keeps its keys on disk and writes what a batch changed, not all keys.
STORE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside use the incremental store; a started query keeps its own copy of the settings."""
    before = {k: spark.conf.get(k, None) for k in STORE_CONF}
    try:
        for k, v in STORE_CONF.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, old in before.items():
            spark.conf.unset(k) if old is None else spark.conf.set(k, old)


# --------------------------------------------------------------------------- row-wise state
EPOCH, MICROSECOND = datetime(1970, 1, 1, tzinfo=timezone.utc), timedelta(microseconds=1)


class FirstDigest(StatefulProcessor):
    """Remembers the first digest of an id for ever, and tells of every later one whether it is the same.

    Rows are (request_id, request_digest, receipts with it, ts and receipt_id of the earliest of them);
    the first digest is that of the earliest row of the first batch that has the id.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "digest string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known = self.first.get() if self.first.exists() else None
        if known is None:
            rows = list(rows)  # a row per digest and task, whatever the number of receipts
            known = (min(rows, key=lambda r: (r["ts"], r["receipt_id"]))["request_digest"],)
            self.first.update(known)
        for r in rows:
            yield Row(request_id=key[0], request_digest=r["request_digest"], receipts=r["receipts"], first=known[0])


class InEventOrder(StatefulProcessor):
    """Holds rows back until the watermark has passed them, then gives each with the value before it.

    Rows are (ts, value), the value an int.  A key has one timer, for its earliest row; what the
    watermark has passed leaves in order.  Every call to the store costs far more than a row, so
    rows are held, and leave, as blocks of at most ``BLOCK``: a batch adds to a key's blocks, and
    only those of keys whose timer fires are read again.  An output row is (key, at, previous,
    current), three arrays of equal length: microseconds, and values with ``NONE`` for null.
    """

    BLOCK = 4096
    #: Less than every int, so nulls come first among equal times.
    NONE = -(2**31) - 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "block binary")
        self.last = handle.getValueState("last", "value int, timer long")

    @staticmethod
    def _due(at: int) -> int:
        """The first millisecond at which a watermark has passed ``at``."""
        return -(-at // 1000)

    def _state(self) -> tuple:
        return tuple(self.last.get() or (None, None))

    def _wait(self, due: int, value: int | None, timer: int | None) -> None:
        if timer == due:
            return
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(due)
        self.last.update((value, due))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        import numpy as np

        pairs = (((r["ts"] - EPOCH) // MICROSECOND, self.NONE if r["value"] is None else r["value"]) for r in rows)
        firsts = []
        while new := list(islice(pairs, self.BLOCK)):
            block = np.array(new, "<i8")
            self.waiting.appendList([(block.tobytes(),)])
            firsts.append(int(block[:, 0].min()))
        value, timer = self._state()
        due = self._due(min(firsts))
        self._wait(due if timer is None else min(due, timer), value, timer)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        import numpy as np

        held = np.concatenate([np.frombuffer(r[0], "<i8") for r in self.waiting.get()]).reshape(-1, 2)
        held = held[np.lexsort((held[:, 1], held[:, 0]))]
        ready = int(np.searchsorted(held[:, 0], timerValues.getCurrentWatermarkInMs() * 1000, "right"))
        value, _ = self._state()
        for i in range(0, ready, self.BLOCK):
            at, current = held[i : min(i + self.BLOCK, ready)].T
            before = self.NONE if value is None else value
            yield Row(key=key[0], at=at, previous=np.append(before, current[:-1]), current=current)
            value = None if current[-1] == self.NONE else int(current[-1])
        rest = held[ready:]
        if len(rest):
            self.waiting.put([(rest[i : i + self.BLOCK].tobytes(),) for i in range(0, len(rest), self.BLOCK)])
            self._wait(self._due(int(rest[0, 0])), value, None)
        else:
            self.waiting.clear()
            self.last.update((value, None))


# --------------------------------------------------------------------------- a table as state
class BucketedState:
    """One row per key in a Parquet table cut into hash buckets, of which a batch rewrites only those that it touches.

    Layout: ``data/batch_id=n/bucket=b`` holds a bucket as batch n left it, and
    ``manifests/batch_id=n`` says for every bucket which batch wrote it last.  Batch n reads
    manifest n - 1, so repeating it writes the same again.  Versions that neither
    manifest n nor n - 1 names are removed, so the table is as large as its keys plus
    what the last batch replaced.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 64):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path.rstrip("/"), key, schema, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def manifest(self, batch_id: int) -> dict[int, int]:
        """The batch that wrote each bucket last, as batch ``batch_id`` left them; none before the first."""
        if batch_id < 0:
            return {}
        text = self.spark.read.text(f"{self.path}/manifests/batch_id={batch_id}").first()
        return {int(b): n for b, n in json.loads(text[0]).items()}

    def touched(self, batch: DataFrame) -> list[int]:
        """The buckets that hold the batch's keys: at most ``buckets`` numbers."""
        return sorted(r[0] for r in batch.select(self.bucket()).distinct().collect())

    def read(self, batch_id: int, touched: list[int] | None = None) -> DataFrame:
        """State before batch ``batch_id``, of all or of the touched buckets."""
        at = self.manifest(batch_id - 1)
        folders = [f"{self.path}/data/batch_id={n}/bucket={b}" for b, n in at.items() if touched is None or b in touched]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame, batch_id: int, touched: list[int]) -> DataFrame:
        """Make ``rows``, all keys of the touched buckets, their state after batch ``batch_id``; gives it back as read."""
        before = self.manifest(batch_id - 1)
        if touched:
            rows.withColumn("bucket", self.bucket()).repartition(min(len(touched), 64), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch_id={batch_id}")
        now = before | dict.fromkeys(touched, batch_id)
        self.spark.createDataFrame([(json.dumps(now),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifests/batch_id={batch_id}")
        self._tidy(batch_id, before, now)
        return self.read(batch_id + 1, touched)

    def _tidy(self, batch_id: int, before: dict[int, int], now: dict[int, int]) -> None:
        """Remove what batch n - 1 replaced of earlier versions, and the manifest before its own."""
        older = self.manifest(batch_id - 2) if batch_id > 1 and self._exists(f"manifests/batch_id={batch_id - 2}") else {}
        stale = [(b, n) for b, n in older.items() if before.get(b) != n and now.get(b) != n]
        for b, n in stale:
            self._delete(f"data/batch_id={n}/bucket={b}")
        for n in {n for _, n in stale} - {*before.values(), *now.values()}:
            self._delete(f"data/batch_id={n}")
        if older:
            self._delete(f"manifests/batch_id={batch_id - 2}")

    def _folder(self, name: str) -> tuple[Any, Any]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        at, fs = self._folder(name)
        return fs.exists(at)

    def _delete(self, name: str) -> None:
        at, fs = self._folder(name)
        fs.delete(at, True)

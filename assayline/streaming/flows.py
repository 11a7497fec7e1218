"""Streaming operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from assayline.operators.scan import scan_files
from assayline.operators.spread import previous_value
from assayline.streaming.state import BucketedState, FirstDigest, InEventOrder, state_store

IMMEDIATE = ["critical", "high"]
SEVERITIES = ["critical", "high", "medium", "low"]


# --------------------------------------------------------------------------- stateless
def watch_scan(files: DataFrame, detectors: list[str] | None = None, rules: list[str] | None = None) -> DataFrame:
    """Findings of each arriving file version; narrow, so throughput follows the sources."""
    return scan_files(files, detectors, rules)


def monitor_alerts(advisories: DataFrame, dependencies: DataFrame, delay: str = "7 days") -> DataFrame:
    """New advisories against registered dependencies.

    ``advisories`` (stream): ``name, version, vuln_id, severity, fixed_version, ts``;
    ``dependencies`` (static): ``repo_id, name, version``.  Critical and high alerts are
    immediate, the rest goes to the digest.  A repeated (repository, package, version,
    advisory, severity, fixed version) within the delay is dropped; a changed severity
    or fix is an alert of its own, whatever the order of arrival.  Repeated advisories of
    a batch are one before they meet the dependencies, so the join makes alerts, not
    repeats of them; ``discovered_at`` is the newest of the batch.
    """
    once = _newest_in_batch(advisories, ["name", "version", "vuln_id", "severity", "fixed_version"])
    hits = once.withWatermark("ts", delay).join(dependencies.select("repo_id", "name", "version"), ["name", "version"])
    alerts = hits.select(
        "repo_id", F.col("name").alias("package"), F.col("version").alias("installed_version"), "fixed_version",
        F.col("vuln_id").alias("cve_id"), "severity", F.col("ts").alias("discovered_at"),
    )
    news = alerts.dropDuplicatesWithinWatermark(["repo_id", "package", "installed_version", "cve_id", "severity", "fixed_version"])
    return news.withColumn("immediate", F.col("severity").isin(IMMEDIATE))


def _newest_in_batch(rows: DataFrame, keys: list[str], held: int = 200_000) -> DataFrame:
    """``keys`` and ``ts``: the repeats that meet in a micro-batch become their newest row; keeps no state.

    Repeats shrink in the tasks that read them and once more beside their equals, so a hot key moves few
    rows.  A task holds some ``held`` keys; beyond, it passes on what it has, so that repeats may
    remain, but no key is lost.
    """
    import pyarrow as pa

    rows = rows.select(*keys, "ts")

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []

        def merged() -> pa.Table:
            found = pa.concat_tables(kept).group_by(keys, use_threads=False).aggregate([("ts", "max")])
            return found.rename_columns([*keys, "ts"] if found.column_names[0] == keys[0] else ["ts", *keys]).select([*keys, "ts"])

        for batch in batches:
            kept.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in kept) > held:
                kept = [merged()]
                if kept[0].num_rows > held // 2:
                    yield from kept.pop().combine_chunks().to_batches()
        if kept:
            yield from merged().combine_chunks().to_batches()

    return rows.mapInArrow(shrink, rows.schema).repartition(*keys).mapInArrow(shrink, rows.schema)


def fresh_lookup(names: DataFrame, registry: DataFrame, hours: int = 24) -> DataFrame:
    """State of each arriving name: exists, missing, or unknown when the newest fact is too old.

    ``names`` (stream): ``name, ts``; ``registry`` (static): ``name, exists, checked_at``.
    """
    newest = registry.groupBy("name").agg(F.max(F.struct("checked_at", "exists")).alias("_fact"))
    joined = names.join(newest, "name", "left")
    fresh = F.col("_fact.checked_at") > F.col("ts") - F.make_interval(hours=F.lit(hours))
    state = F.when(~F.coalesce(fresh, F.lit(False)), "unknown").when(F.col("_fact.exists"), "exists").otherwise("missing")
    return joined.select(*names.columns, state.alias("state"))


# --------------------------------------------------------------------------- keyed state
def one_time_approval(receipts: DataFrame, rows_per_step: int = 10_000) -> DataFrame:
    """``request_id, receipt_id, request_digest, accepted``: a receipt is accepted unless its request id was used before with another digest.

    ``receipts`` (stream): ``request_id, receipt_id, request_digest, ts``.  The first digest of an
    id is that of the earliest receipt by (ts, receipt_id) in the first batch that has the
    id, and is never forgotten.  It is in Spark's state store, so a batch costs what it
    brings.  Receipts are gathered per id and digest before they are dealt out, some
    thousand at a time: a replayed id sends the state few rows, not one per receipt.
    Start it inside :func:`assayline.streaming.state.state_store`.
    """
    import pyarrow as pa

    kind = dict(receipts.dtypes)["request_id"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, rows_per_step):
                rows = pa.Table.from_batches([batch.slice(i, rows_per_step)]).sort_by([("ts", "ascending"), ("receipt_id", "ascending")])
                found = rows.group_by(["request_id", "request_digest"], use_threads=False).aggregate([("receipt_id", "list"), ("ts", "first"), ("receipt_id", "first")])
                columns = [found[c].combine_chunks() for c in ("request_id", "request_digest", "receipt_id_list", "ts_first", "receipt_id_first")]
                yield pa.RecordBatch.from_arrays(columns, ["request_id", "request_digest", "receipts", "ts", "receipt_id"])

    gathered = receipts.select("request_id", F.col("receipt_id").cast("long"), F.col("request_digest").cast("string"), "ts").mapInArrow(
        gather, f"request_id {kind}, request_digest string, receipts array<long>, ts timestamp, receipt_id long"
    )
    judged = gathered.groupBy("request_id").transformWithState(
        FirstDigest(), f"request_id {kind}, request_digest string, receipts array<long>, first string", "Append", "None"
    )
    return judged.select("request_id", F.explode("receipts").alias("receipt_id"), "request_digest", F.col("request_digest").eqNullSafe(F.col("first")).alias("accepted"))


def score_history(scores: DataFrame, delay: str = "7 days") -> DataFrame:
    """``repo_id, ts, previous, current`` for every scored scan, previous being the score before it in event time.

    ``scores`` (stream): ``repo_id, ts, score``.  A scan waits in the state store until the watermark,
    ``delay`` behind the newest scan, has passed it, so scans may arrive in any order within
    the delay; equal times go by score, nulls first.  Later ones are dropped and counted
    in the query's progress, as the watermark's contract is.  Start it inside
    :func:`assayline.streaming.state.state_store`.
    """
    rows = scores.select("repo_id", "ts", F.col("score").cast("int").alias("value")).withWatermark("ts", delay)
    ordered = rows.groupBy("repo_id").transformWithState(
        InEventOrder(), "key string, at array<long>, previous array<long>, current array<long>", "Append", "EventTime"
    )
    each = ordered.select(F.col("key").alias("repo_id"), F.explode(F.arrays_zip("at", "previous", "current")).alias("r"))
    values = [F.nullif(F.col(f"r.{c}"), F.lit(InEventOrder.NONE)).cast("int").alias(c) for c in ("previous", "current")]
    return each.select("repo_id", F.timestamp_micros("r.at").alias("ts"), *values)


# --------------------------------------------------------------------------- batch bodies
def _write(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


Body = Callable[[DataFrame, int], None]


def weekly_digest(out: str) -> Body:
    """``foreachBatch`` body: what a batch adds to the counts per repository and week; :func:`digest_of` sums them.

    The batch has ``repo_id, severity, discovered_at``; a week starts on Sunday 09:00 UTC.
    A late row adds to its own week, so nothing is lost and the open week is there too.
    """
    week = F.window("discovered_at", "7 days", "7 days", "3 days 9 hours")
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]

    def body(batch: DataFrame, batch_id: int) -> None:
        added = batch.groupBy("repo_id", week.alias("w")).agg(F.count(F.lit(1)).alias("alerts"), *counts)
        _write(added.select("repo_id", F.col("w.start").alias("week_start"), F.col("w.end").alias("week_end"), "alerts", *SEVERITIES), out, batch_id)

    return body


def digest_of(added: DataFrame) -> DataFrame:
    """One row per repository and week from the rows that :func:`weekly_digest` wrote."""
    return added.groupBy("repo_id", "week_start", "week_end").agg(*[F.sum(c).alias(c) for c in ("alerts", *SEVERITIES)])


def deliver_if_changed(out: str, buckets: int = 64) -> Body:
    """``foreachBatch`` body: write the payload of a key only when its digest differs from the one before.

    The batch is ``key, ts, digest``.  The newest (ts, digest) per key is kept in a
    :class:`~assayline.streaming.state.BucketedState`, so a batch reads and rewrites the buckets of its
    own keys.  A row older than what its key had already is not delivered over it, but
    written to ``{out}_late``.
    """

    def body(batch: DataFrame, batch_id: int) -> None:
        state = BucketedState(batch.sparkSession, f"{out}_state", "key", "key string, _ts timestamp, _last string", buckets)
        batch = batch.select("key", "ts", "digest").persist()
        try:
            touched = state.touched(batch)
            known = state.read(batch_id, touched).persist()
            joined = batch.join(known, "key", "left")
            late = F.coalesce(F.col("ts") < F.col("_ts"), F.lit(False))
            _write(joined.where(late).select("key", "ts", "digest"), f"{out}_late", batch_id)
            rows = joined.where(~late).select("key", "ts", "digest")
            first = F.struct(F.lit(False).alias("first"), F.col("digest").alias("value"))
            marked = previous_value(rows.withColumn("_v", first), ["key"], ["ts", "digest"], "_v", F.to_date("ts"), "_p")
            before = marked.join(known.select("key", "_last"), "key", "left").withColumn("_prev", F.when(F.col("_p").isNull(), F.col("_last")).otherwise(F.col("_p.value")))
            _write(before.where(~F.col("_prev").eqNullSafe(F.col("digest"))).select("key", "ts", "digest"), out, batch_id)
            newest = rows.groupBy("key").agg(F.max(F.struct("ts", "digest")).alias("_n"))
            after = newest.join(known, "key", "full").select("key", F.coalesce("_n.ts", "_ts").alias("_ts"), F.when(F.col("_n").isNotNull(), F.col("_n.digest")).otherwise(F.col("_last")).alias("_last"))
            state.write(after, batch_id, touched)
            known.unpersist()
        finally:
            batch.unpersist()

    return body


def score_momentum(scores: DataFrame) -> DataFrame:
    """``repo_id, ts, previous, current, delta`` over a batch of ``repo_id, ts, score``."""
    rows = previous_value(
        scores.select("repo_id", "ts", F.col("score").alias("current")), ["repo_id"], ["ts", "current"], "current", F.to_date("ts"), "previous"
    )
    return rows.withColumn("delta", F.col("current") - F.col("previous"))


# --------------------------------------------------------------------------- running
def run_available(
    stream: DataFrame, checkpoint: str, out: str | None = None, body: Callable[[DataFrame, int], None] | None = None,
    mode: str = "append",
) -> None:
    """Process what is there and stop; to a Parquet folder or through a batch body."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query: StreamingQuery
    with state_store(stream.sparkSession):
        if body is not None:
            query = writer.foreachBatch(body).start()
        else:
            assert out is not None
            query = writer.format("parquet").start(out)
    query.awaitTermination()


def as_event_time(col: Column) -> Column:
    """Parquet's zone-less timestamps as UTC instants, which watermarks need."""
    return col.cast("timestamp")

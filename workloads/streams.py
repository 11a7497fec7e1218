"""Streaming queries: the tables as file streams, processed with ``availableNow``.

A query runs its stream to the end into a folder below the cluster's checkpoint
folder and returns that folder as a DataFrame.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.session import checkpoint_dir
from assayline.streaming import flows
from workloads import query
from workloads.bindings import pick, sql_pick, table
from workloads.rule_pack import CRED, R, m


def _source(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table, one file or a folder of files, as a file stream with its own schema.

    The braces make the path a pattern: a stream takes a plain path for a folder.
    """
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{{{name}}}.parquet")


def _folders(spark: SparkSession) -> tuple[str, str]:
    base = f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    return base + "/checkpoint", base + "/out"


def _finish(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    checkpoint, out = _folders(spark)
    flows.run_available(stream, checkpoint, out, mode=mode)
    return spark.read.schema(stream.schema).parquet(out)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return _source(spark, sf, "events").withColumn("ts", flows.as_event_time(F.col("ts")))


@query(
    "watch_scan",
    f"""WITH docs AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), L AS (SELECT * FROM docs WHERE NOT {m(R.METADATA_LINE)})
SELECT source AS repo_id, 'text/' || doc_id || '.txt' AS file, {CRED} AS label, count(*)::BIGINT AS hits FROM L WHERE {CRED} IS NOT NULL GROUP BY ALL""",
)
def watch_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Documents arrive as files; findings are appended, then counted."""
    stream = _source(spark, sf, "documents").select(
        F.col("source").alias("repo_id"), F.concat(F.lit("text/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("text").alias("content"),
    )
    found = flows.watch_scan(stream, rules=["D4-001"]).select("repo_id", "file", "line", "label")
    return _finish(spark, found).groupBy("repo_id", "file", "label").agg(F.count(F.lit(1)).alias("hits"))


_SEV = ["critical", "high", "medium", "low"]


def _alert_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    adv = _events(spark, sf).select(
        F.concat(F.lit("pkg"), (F.col("user_id") % 30).cast("string")).alias("name"), F.lit("1.0").alias("version"),
        F.concat(F.lit("ADV-"), (F.col("event_id") % 400).cast("string")).alias("vuln_id"), pick(_SEV, F.col("user_id") % 4).alias("severity"),
        F.concat(F.lit("1."), (F.col("user_id") % 3).cast("string")).alias("fixed_version"), "ts",
    )
    deps = table(spark, sf, "supplier").select(
        F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("repo_id"),
        F.concat(F.lit("pkg"), (F.col("s_suppkey") % 45).cast("string")).alias("name"), F.lit("1.0").alias("version"),
    )
    return adv, deps


@query(
    "monitor_alerts",
    f"""WITH a AS (SELECT DISTINCT 'pkg' || (user_id % 30) AS name, 'ADV-' || (event_id % 400) AS cve_id, {sql_pick(_SEV, 'user_id % 4')} AS severity, '1.' || (user_id % 3) AS fixed_version FROM events),
d AS (SELECT 'r' || s_suppkey AS repo_id, 'pkg' || (s_suppkey % 45) AS name FROM supplier) SELECT repo_id, name AS package, cve_id, '1.0' AS installed_version, fixed_version, severity, severity IN ('critical', 'high') AS immediate FROM a JOIN d USING (name)""",
)
def monitor_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """One alert per repository, package, advisory, severity and fix over the whole month (the delay exceeds it)."""
    adv, deps = _alert_rows(spark, sf)
    return _finish(spark, flows.monitor_alerts(adv, deps, "60 days")).drop("discovered_at")


_DIGEST = (
    "SELECT repo_id, week_start, week_end, count(*)::BIGINT AS alerts, " + ", ".join(f"count(*) FILTER (severity = '{s}')::BIGINT AS {s}" for s in _SEV)
    + " FROM w GROUP BY ALL"
)


@query(
    "weekly_digest",
    f"""WITH e AS (SELECT 'r' || (user_id % 25) AS repo_id, {sql_pick(_SEV, 'event_id % 4')} AS severity, ts FROM events),
w AS (SELECT *, TIMESTAMP '1970-01-04 09:00:00' + to_days((7 * floor(epoch(ts - TIMESTAMP '1970-01-04 09:00:00') / 604800))::INT) AS week_start,
 TIMESTAMP '1970-01-04 09:00:00' + to_days((7 * floor(epoch(ts - TIMESTAMP '1970-01-04 09:00:00') / 604800) + 7)::INT) AS week_end FROM e) {_DIGEST}""",
)
def weekly_digest(spark: SparkSession, sf: str) -> DataFrame:
    """All weeks, the open one too."""
    alerts = _events(spark, sf).select(
        F.concat(F.lit("r"), (F.col("user_id") % 25).cast("string")).alias("repo_id"), pick(_SEV, F.col("event_id") % 4).alias("severity"),
        F.col("ts").alias("discovered_at"),
    )
    schema = "repo_id string, week_start timestamp, week_end timestamp, alerts bigint, " + ", ".join(f"{s} bigint" for s in _SEV)
    out = flows.digest_of(_through(spark, alerts, flows.weekly_digest, schema))
    return out.withColumn("week_start", F.col("week_start").cast("timestamp_ntz")).withColumn("week_end", F.col("week_end").cast("timestamp_ntz"))


@query(
    "fresh_lookup",
    "WITH r AS (SELECT 'pkg' || p_partkey AS name, p_size > 10 AS e, TIMESTAMP '2024-01-01' + to_days((p_partkey % 30)::INT) AS c FROM part) SELECT event_id, 'pkg' || (user_id % 250) AS name, CASE WHEN c IS NULL "
    "OR NOT c > ts - INTERVAL 240 HOUR THEN 'unknown' WHEN e THEN 'exists' ELSE 'missing' END AS state FROM events LEFT JOIN r ON r.name = 'pkg' || (user_id % 250)",
)
def fresh_lookup(spark: SparkSession, sf: str) -> DataFrame:
    names = _events(spark, sf).select("event_id", F.concat(F.lit("pkg"), (F.col("user_id") % 250).cast("string")).alias("name"), "ts")
    registry = table(spark, sf, "part").select(
        F.concat(F.lit("pkg"), F.col("p_partkey").cast("string")).alias("name"), (F.col("p_size") > 10).alias("exists"),
        F.expr("TIMESTAMP '2024-01-01' + make_interval(0, 0, 0, CAST(p_partkey % 30 AS INT))").alias("checked_at"),
    )
    return _finish(spark, flows.fresh_lookup(names, registry, 240)).select("event_id", "name", "state")


@query(
    "one_time_approval",
    "SELECT user_id AS request_id, event_id AS receipt_id, 'd' || (event_id % 3) AS request_digest, 'd' || (event_id % 3) = first_value('d' || (event_id % 3)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS accepted FROM events",
)
def one_time_approval(spark: SparkSession, sf: str) -> DataFrame:
    receipts = _events(spark, sf).select(
        F.col("user_id").alias("request_id"), F.col("event_id").alias("receipt_id"),
        F.concat(F.lit("d"), (F.col("event_id") % 3).cast("string")).alias("request_digest"), "ts",
    )
    return _finish(spark, flows.one_time_approval(receipts))


def _through(spark: SparkSession, stream: DataFrame, body_of: object, schema: str) -> DataFrame:
    checkpoint, out = _folders(spark)
    flows.run_available(stream, checkpoint, body=body_of(out))  # type: ignore[operator]
    return spark.read.schema(schema + ", batch_id bigint").parquet(out).drop("batch_id")


@query(
    "deliver_if_changed",
    "WITH e AS (SELECT 'u' || user_id AS key, ts, 'd' || (event_id % 3) AS digest FROM events), l AS (SELECT *, lag(digest) OVER (PARTITION BY key ORDER BY ts, digest) AS p FROM e) SELECT key, ts, digest FROM l WHERE p IS DISTINCT FROM digest",
)
def deliver_if_changed(spark: SparkSession, sf: str) -> DataFrame:
    payloads = _events(spark, sf).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), "ts", F.concat(F.lit("d"), (F.col("event_id") % 3).cast("string")).alias("digest")
    )
    out = _through(spark, payloads, flows.deliver_if_changed, "key string, ts timestamp, digest string")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_SCORE = "(event_id * 7 % 101)::INT"


@query(
    "score_history",
    f"SELECT 'u' || user_id AS repo_id, ts, lag({_SCORE}) OVER (PARTITION BY user_id ORDER BY ts, {_SCORE}) AS previous, {_SCORE} AS current FROM events",
)
def score_history(spark: SparkSession, sf: str) -> DataFrame:
    """The month arrives as it is; a closing row, far ahead, moves the watermark past all of it."""
    scores = _events(spark, sf).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("repo_id"), "ts", (F.col("event_id") * 7 % 101).cast("int").alias("score")
    )
    closing = f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}/closing"
    spark.sql("SELECT CAST(NULL AS STRING) AS repo_id, TIMESTAMP '2999-01-01' AS ts, 0 AS score").write.parquet(closing)
    end = spark.readStream.schema(scores.schema).parquet(closing)
    return _finish(spark, flows.score_history(scores.union(end), "60 days")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "score_momentum",
    f"SELECT 'u' || user_id AS repo_id, ts, lag({_SCORE}) OVER (PARTITION BY user_id ORDER BY ts, {_SCORE}) AS previous, {_SCORE} AS current, {_SCORE} - lag({_SCORE}) OVER (PARTITION BY user_id ORDER BY ts, {_SCORE}) AS delta FROM events",
)
def score_momentum(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("repo_id"), "ts", (F.col("event_id") * 7 % 101).cast("int").alias("score")
    )
    return flows.score_momentum(rows)



"""Streams give the batch answer, over several micro-batches and after a restart."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from assayline.streaming import flows
from assayline.streaming.state import BucketedState, InEventOrder, state_store


def source(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def write(spark, rows, schema, path, name):
    spark.createDataFrame(rows, schema).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(path / name))


SCHEMA = "key string, ts string, digest string"
TYPED = "key string, ts timestamp, digest string"


def test_deliver_if_changed_over_batches_and_restart(spark, tmp_path):
    data = tmp_path / "in"
    write(spark, [("a", "2024-01-01", "x"), ("a", "2024-01-02", "x"), ("b", "2024-01-01", "y")], SCHEMA, data, "1")
    write(spark, [("a", "2024-01-03", "x"), ("a", "2024-01-04", "z")], SCHEMA, data, "2")
    src = spark.readStream.schema(TYPED).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(data))
    out = str(tmp_path / "out")
    flows.run_available(src, str(tmp_path / "cp"), body=flows.deliver_if_changed(out))
    write(spark, [("b", "2024-01-05", "y"), ("c", "2024-01-05", "n")], SCHEMA, data, "3")
    flows.run_available(src, str(tmp_path / "cp"), body=flows.deliver_if_changed(out))
    got = {(r.key, str(r.ts.date()), r.digest) for r in spark.read.parquet(out).collect()}
    assert got == {("a", "2024-01-01", "x"), ("b", "2024-01-01", "y"), ("a", "2024-01-04", "z"), ("c", "2024-01-05", "n")}


def test_one_time_approval_keeps_the_first_digest(spark, tmp_path):
    schema = "request_id bigint, receipt_id bigint, request_digest string, ts string"
    data = tmp_path / "in"
    write(spark, [(1, 1, "a", "2024-01-01"), (1, 2, "b", "2024-01-02"), (2, 3, "c", "2024-01-01")], schema, data, "1")
    write(spark, [(1, 4, "a", "2024-01-03"), (2, 5, "d", "2024-01-03")], schema, data, "2")
    src = spark.readStream.schema(schema.replace("ts string", "ts timestamp")).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(data))
    flows.run_available(flows.one_time_approval(src), str(tmp_path / "cp"), str(tmp_path / "out"))
    write(spark, [(2, 6, "c", "2024-01-01"), (3, 7, None, "2024-01-01"), (3, 8, "e", "2024-01-02"), (None, 9, "f", "2024-01-02")], schema, data, "3")
    flows.run_available(flows.one_time_approval(src), str(tmp_path / "cp"), str(tmp_path / "out"))
    got = {r.receipt_id: r.accepted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: True, 2: False, 3: True, 4: True, 5: False, 6: True, 7: True, 8: False, 9: True}


def test_first_receipt_of_a_hot_id_is_the_earliest_of_all(spark, tmp_path):
    schema = "request_id bigint, receipt_id bigint, request_digest string, ts timestamp"
    late = spark.range(1, 25_000).select(F.lit(1).cast("bigint").alias("request_id"), F.col("id").alias("receipt_id"), F.lit("b").alias("request_digest"), F.to_timestamp(F.lit("2024-01-02")).alias("ts"))
    first = spark.createDataFrame([(1, 0, "a", "2024-01-01")], "request_id bigint, receipt_id bigint, request_digest string, ts string").withColumn("ts", F.to_timestamp("ts"))
    late.union(first).coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    flows.run_available(flows.one_time_approval(src), str(tmp_path / "cp"), str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("accepted", "request_digest").count().collect()
    assert {(r.accepted, r.request_digest, r["count"]) for r in got} == {(True, "a", 1), (False, "b", 24_999)}


def test_late_rows_stand_aside_and_state_stays_one_row_per_key(spark, tmp_path):
    out = str(tmp_path / "out")
    body = flows.deliver_if_changed(out)
    day = lambda rows: spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.to_timestamp("ts"))
    body(day([("a", "2024-01-05", "x"), ("a", "2024-01-04", "y")]), 0)
    for _ in range(2):  # a repeated batch changes nothing
        body(day([("a", "2024-01-03", "z"), ("a", "2024-01-06", "x"), ("b", "2024-01-01", None)]), 1)
    body(day([("a", "2024-01-07", "q")]), 2)
    got = {(r.key, str(r.ts.date()), r.digest) for r in spark.read.parquet(out).collect()}
    assert got == {("a", "2024-01-04", "y"), ("a", "2024-01-05", "x"), ("a", "2024-01-07", "q")}
    assert [(r.key, r.digest) for r in spark.read.parquet(out + "_late").collect()] == [("a", "z")]
    kept = BucketedState(spark, out + "_state", "key", "key string, _ts timestamp, _last string").read(3)
    assert {(r.key, r._last) for r in kept.collect()} == {("a", "q"), ("b", None)}


def test_a_batch_writes_the_buckets_of_its_keys_and_old_versions_go(spark, tmp_path):
    """A large first batch, then small ones: they write a bucket each, and the table stays as large as its keys."""
    out = str(tmp_path / "out")
    body = flows.deliver_if_changed(out, buckets=16)
    day = lambda rows: spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.to_timestamp("ts"))
    state = BucketedState(spark, out + "_state", "key", "key string, _ts timestamp, _last string", 16)
    body(day([(f"k{i}", "2024-01-01", "x") for i in range(400)]), 0)
    folders = lambda n: {p.name for p in (tmp_path / f"out_state/data/batch_id={n}").glob("bucket=*")}
    assert len(folders(0)) == 16
    for n in range(1, 5):
        for _ in range(2):  # a repeated batch writes the same
            body(day([("k1", f"2024-02-{n:02d}", f"d{n}"), ("k1", "2023-01-01", "old")]), n)
        assert len(folders(n)) == 1
    versions = sorted(p.name for p in (tmp_path / "out_state/data").iterdir())
    assert versions == ["batch_id=0", "batch_id=3", "batch_id=4"] and len(list((tmp_path / "out_state/manifests").iterdir())) == 2
    kept = {r.key: r._last for r in state.read(5).collect()}
    assert len(kept) == 400 and kept["k1"] == "d4" and kept["k2"] == "x"
    assert spark.read.parquet(out).where("key = 'k1'").count() == 5 and spark.read.parquet(out + "_late").count() == 4


def test_approvals_cost_what_they_bring(spark, tmp_path):
    """Fifty batches of their own ids: each updates its own keys only, while the store keeps all of them."""
    schema = "request_id bigint, receipt_id bigint, request_digest string, ts timestamp"
    rows = spark.range(50 * 20).select((F.col("id")).alias("request_id"), F.col("id").alias("receipt_id"), F.lit("d").alias("request_digest"), F.to_timestamp(F.lit("2024-01-01")).alias("ts"), F.floor(F.col("id") / 20).alias("n"))
    rows.repartition(1).sortWithinPartitions("n").write.partitionBy("n").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with state_store(spark):
        query = flows.one_time_approval(src).writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
    query.awaitTermination()
    steps = [p.stateOperators[0] for p in query.recentProgress if p.numInputRows]
    assert len(steps) == 50 and {s.numRowsUpdated for s in steps} == {20} and steps[-1].numRowsTotal == 1000
    assert spark.read.parquet(str(tmp_path / "out")).where("accepted").count() == 1000


def test_scores_arriving_in_any_order_follow_their_predecessor(spark, tmp_path):
    """Shuffled arrival over several batches and a restart gives the sorted answer."""
    rng = random.Random(4)
    rows = [(f"r{rng.randrange(3)}", f"2024-01-{d:02d} 00:00:{s:02d}.000{d:03d}", None if rng.random() < 0.1 else rng.randrange(100)) for d in range(1, 29) for s in range(4)]
    want, last = [], {}
    for repo, ts, score in sorted(rows, key=lambda r: r[1]):
        want.append((repo, ts, last.get(repo), score))
        last[repo] = score
    arrival = sorted(rows, key=lambda r: int(r[1][8:10]) + rng.random() * 6)
    schema, typed = "repo_id string, ts string, score int", "repo_id string, ts timestamp, score int"
    (tmp_path / "in").mkdir()
    src = spark.readStream.schema(typed).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    parts = [arrival[i : i + 16] for i in range(0, len(arrival), 16)] + [[("end", "2999-01-01", 0)]]
    for i, part in enumerate(parts):
        write(spark, part, schema, tmp_path / "in", str(i))
        if i in (3, len(parts) - 1):
            flows.run_available(flows.score_history(src, "10 days"), str(tmp_path / "cp"), str(tmp_path / "out"))
    got = [(r.repo_id, r.t, r.previous, r.current) for r in spark.read.parquet(str(tmp_path / "out")).withColumn("t", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).collect()]
    assert sorted(got, key=lambda r: r[1]) == want


def test_scores_are_held_in_blocks_and_only_late_ones_are_dropped(spark, tmp_path):
    """The store is asked per key and block, not per score; blocks that the watermark cuts keep their rest."""
    n, at = InEventOrder.BLOCK + 100, "timestamp_micros(1704067200000000 + {} * 7000001L)".format
    value = "CAST(CASE WHEN id % 5 > 0 THEN id % 11 - 5 END AS INT)"
    big = spark.range(n).selectExpr("'big' AS repo_id", f"{at('(id * 1237 % ' + str(n) + ') div 2')} AS ts", f"{value} AS score")
    small = spark.range(40).selectExpr("'s' || id % 4 AS repo_id", f"{at('id')} AS ts", f"{value} AS score")
    scores = big.union(small)
    one = lambda repo, ts: spark.sql(f"SELECT '{repo}' AS repo_id, {ts} AS ts, CAST(9 AS INT) AS score")
    arriving = [scores, one("s0", at(n // 3) + " + INTERVAL 1 HOUR"), one("big", at(1)), one("end", "TIMESTAMP '2999-01-01'")]
    (tmp_path / "in").mkdir()
    src = spark.readStream.schema(scores.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    progress = []
    for i, rows in enumerate(arriving):
        rows.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        with state_store(spark):
            writer = flows.score_history(src, "1 hour").writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
            query = writer.format("parquet").start(str(tmp_path / "out"))
        query.awaitTermination()
        progress.append([p.stateOperators[0] for p in query.recentProgress])
        if i == 2:
            assert 0 < spark.read.parquet(str(tmp_path / "out")).where("repo_id = 'big'").count() < n
    assert progress[0][0].numRowsUpdated <= 2 * 5 + 1
    assert sum(s.numRowsDroppedByWatermark for steps in progress for s in steps) == 1
    want = scores.union(arriving[1]).selectExpr("repo_id", "ts", "lag(score) OVER (PARTITION BY repo_id ORDER BY ts, score) AS previous", "score AS current")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.dtypes == want.dtypes and got.count() == n + 41
    assert got.exceptAll(want).count() == 0


def test_a_raised_severity_alerts_whatever_comes_first(spark, tmp_path):
    schema = "name string, version string, vuln_id string, severity string, fixed_version string, ts string"
    for i, order in enumerate((["medium", "critical"], ["critical", "medium"])):
        data = tmp_path / f"in{i}"
        write(spark, [("p", "1", "V", s, "2", "2024-01-01") for s in [*order, order[0]]], schema, data, "1")
        src = spark.readStream.schema(schema.replace("ts string", "ts timestamp")).option("recursiveFileLookup", "true").parquet(str(data))
        deps = spark.createDataFrame([("r", "p", "1")], "repo_id string, name string, version string")
        flows.run_available(flows.monitor_alerts(src, deps), str(tmp_path / f"cp{i}"), str(tmp_path / f"out{i}"))
        got = {(r.severity, r.immediate) for r in spark.read.parquet(str(tmp_path / f"out{i}")).collect()}
        assert got == {("medium", False), ("critical", True)}


def test_late_alerts_count_in_their_week(spark, tmp_path):
    out = str(tmp_path / "out")
    body = flows.weekly_digest(out)
    day = lambda rows: spark.createDataFrame(rows, "repo_id string, severity string, ts string").select("repo_id", "severity", F.to_timestamp("ts").alias("discovered_at"))
    body(day([("r", "high", "2024-03-20"), ("r", "low", "2024-03-20")]), 0)
    body(day([("r", "high", "2024-01-10")]), 1)
    body(day([("r", "critical", "2024-03-21")]), 2)
    got = {(str(r.week_start.date()), r.alerts, r.critical, r.high) for r in flows.digest_of(spark.read.parquet(out)).collect()}
    assert got == {("2024-03-17", 3, 1, 1), ("2024-01-07", 1, 0, 1)}


def test_checkpoint_folder_is_not_made_up_on_a_cluster():
    from types import SimpleNamespace

    import pytest

    from assayline.session import checkpoint_dir

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError):
        checkpoint_dir(far)


def test_a_streamed_table_may_be_a_file_or_a_folder(spark, tmp_path):
    from workloads.streams import _source

    spark.range(10).repartition(2).write.parquet(str(tmp_path / "folder" / "events.parquet"))
    part = next((tmp_path / "folder" / "events.parquet").glob("part-*.parquet"))
    (tmp_path / "file").mkdir()
    (tmp_path / "file" / "events.parquet").write_bytes(part.read_bytes())
    for form, rows in (("folder", 10), ("file", spark.read.parquet(str(part)).count())):
        flows.run_available(_source(spark, str(tmp_path / form), "events"), str(tmp_path / f"cp_{form}"), str(tmp_path / f"out_{form}"))
        assert spark.read.parquet(str(tmp_path / f"out_{form}")).count() == rows


def test_repeated_advisories_of_a_batch_meet_the_dependencies_once(spark):
    schema = "name string, version string, ts timestamp"
    rows = spark.range(3_000).selectExpr("IF(id % 7 = 0, NULL, concat('p', id % 7)) AS name", "'1' AS version", "timestamp_seconds(id) AS ts").repartition(3)
    want = {(None if k == 0 else f"p{k}"): max(i for i in range(3_000) if i % 7 == k) for k in range(7)}
    got = flows._newest_in_batch(rows, ["name", "version"])
    assert got.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
    found = got.select("name", F.unix_timestamp("ts").alias("ts")).collect()
    assert len(found) == 7 and {r.name: r.ts for r in found} == want
    tight = flows._newest_in_batch(rows, ["name", "version"], held=2).groupBy("name").agg(F.unix_timestamp(F.max("ts")).alias("ts")).collect()
    assert {r.name: r.ts for r in tight} == want

"""The source-tree data source: the reader's rows, pruned folders, and a stream that restarts."""

from __future__ import annotations

import time

from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringStartsWith

from assayline.sources.files import scan_source_files
from assayline.sources.tree import TreeReader, read_tree, register, watch_tree
from assayline.streaming import flows


def put(root, *paths, text="x = 1\n"):
    for p in paths:
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(text + p)


FILES = ["a/x.js", "a/.env", "a/src/y.ts", "a/src/deep/er/z.md", "a/srcs/no.ts", "a/node_modules/q.js", "a/src/dist/q.js", "b/src/w.json", "b/pic.png", "b/ignored/i.js", "c/src/v.yaml", "top.js"]


def test_same_rows_as_the_listing_reader(spark, tmp_path):
    put(tmp_path, *FILES)
    (tmp_path / "b/src/bad.js").write_bytes(b"\xff\xfe ok")
    rows = lambda df: sorted((r.repo_id, r.path, r.content) for r in df.collect())
    for ignore in ([], ["**/ignored/**", "src/deep/**"]):
        assert rows(read_tree(spark, str(tmp_path), ignore)) == rows(scan_source_files(spark, str(tmp_path), ignore))
    register(spark)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW tree USING source_tree OPTIONS (path '{tmp_path}')")
    assert [r.path for r in spark.sql("SELECT path FROM tree WHERE repo_id = 'c'").collect()] == ["src/v.yaml"]
    assert read_tree(spark, str(tmp_path / "none")).count() == 0


def test_filters_prune_folders(spark, tmp_path):
    put(tmp_path, *FILES)

    def planned(*filters):
        reader = TreeReader({"path": str(tmp_path)})
        left = list(reader.pushFilters(list(filters)))
        return sorted((p.repo, p.folder) for p in reader.partitions()), left

    assert planned()[0] == [("a", ""), ("a", "src"), ("a", "srcs"), ("b", ""), ("b", "ignored"), ("b", "src"), ("c", ""), ("c", "src")]
    assert planned(EqualTo(("repo_id",), "b")) == ([("b", ""), ("b", "ignored"), ("b", "src")], [])
    assert planned(In(("repo_id",), ("a", "c", "nope", "../x")), StringStartsWith(("path",), "src/")) == ([("a", "src"), ("c", "src")], [])
    assert planned(StringStartsWith(("path",), "src")) == ([("a", ""), ("a", "src"), ("a", "srcs"), ("b", ""), ("b", "src"), ("c", ""), ("c", "src")], [])
    exact = EqualTo(("path",), "src/y.ts")
    assert planned(EqualTo(("repo_id",), "a"), exact) == ([("a", "src")], [exact])
    tree = read_tree(spark, str(tmp_path))
    some = tree.where((F.col("repo_id") == "a") & F.col("path").startswith("src/"))
    assert sorted(r.path for r in some.collect()) == ["src/deep/er/z.md", "src/y.ts"]
    assert some.rdd.getNumPartitions() == 1 and tree.where("repo_id IN ('a', 'c')").rdd.getNumPartitions() == 5


def test_a_watched_tree_goes_on_after_a_restart(spark, tmp_path):
    root, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    put(root, "a/x.js", "a/src/y.js", "b/z.js", text="eval(userInput)\n")
    watched = lambda: watch_tree(spark, str(root), settle_ms=50).select("repo_id", "path", F.length("content").alias("size"))
    seen = lambda: sorted((r.repo_id, r.path) for r in spark.read.parquet(out).collect())
    time.sleep(0.2)
    flows.run_available(watched(), cp, out)
    assert seen() == [("a", "src/y.js"), ("a", "x.js"), ("b", "z.js")]
    time.sleep(0.2)
    flows.run_available(watched(), cp, out)  # nothing is new
    assert len(seen()) == 3
    put(root, "a/src/y.js", "c/new.js", text="changed\n")
    put(root, "c/node_modules/no.js")
    time.sleep(0.2)
    flows.run_available(watched(), cp, out)
    assert seen() == [("a", "src/y.js"), ("a", "src/y.js"), ("a", "x.js"), ("b", "z.js"), ("c", "new.js")]
    found = flows.watch_scan(watch_tree(spark, str(root), settle_ms=50))
    flows.run_available(found, str(tmp_path / "cp2"), str(tmp_path / "found"))
    assert spark.read.schema(found.schema).parquet(str(tmp_path / "found")).where("repo_id = 'b'").count() > 0

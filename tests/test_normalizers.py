"""Formats plugged in as a table function."""

from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from assayline.plans.normalizers import CYCLONEDX_COMPONENTS, DETECT_SECRETS, Format, normalized, normalizer, register_normalizers
from assayline.sources import evidence


def test_a_format_of_the_users_own_from_sql(spark):
    def owners(doc):
        for path, people in doc["owners"].items():
            for person in people:
                yield path, person["name"], [r["role"] for r in person.get("roles", [])]

    OWNERS = Format("owners", "path string, name string, roles array<string>", owners)
    register_normalizers(spark, OWNERS, name="with_owners")
    docs = [(1, '{"owners": {"a/": [{"name": "x", "roles": [{"role": "r1"}, {"role": "r2"}]}, {"name": "y"}], "b/": []}}'), (2, None), (3, "{"), (4, '{"owners": []}'), (5, '{"owners": {"c": [{"name": "z"}, {}]}}')]
    spark.createDataFrame(docs, "doc_id int, raw string").createOrReplaceTempView("owner_docs")
    got = spark.sql("SELECT doc_id, n.* FROM owner_docs d, LATERAL with_owners(d.raw, 'owners') n").collect()
    assert sorted((r.doc_id, r.path, r.name, r.roles) for r in got) == [(1, "a/", "x", ["r1", "r2"]), (1, "a/", "y", [])]
    # Columns follow the format.
    assert spark.sql("SELECT * FROM with_owners('{}', 'detect-secrets')").columns == ["path", "type", "line", "hashed_secret", "verified"]
    for bad in ("SELECT * FROM with_owners('{}', 'nope')", "SELECT n.* FROM owner_docs d, LATERAL with_owners(d.raw, d.raw) n", "SELECT * FROM with_owners(3, 'owners')"):
        with pytest.raises(AnalysisException):
            spark.sql(bad).collect()
    with pytest.raises(ValueError):
        normalizer((OWNERS, OWNERS))


def test_plugged_in_twin_of_a_built_in_importer(spark):
    docs = spark.createDataFrame(
        [
            (1, '{"bomFormat":"CycloneDX","components":[{"type":"library","name":"a","hashes":[{"alg":"x","content":"y"}]},{"type":"file","bom-ref":"f","hashes":[]}]}'),
            (2, '{"bomFormat":"CycloneDX","components":[{"type":"library","name":"a"},{"name":"b"}]}'), (3, '{"bomFormat":"Other"}'), (4, '{"bomFormat":"CycloneDX"}'),
            (5, '{"bomFormat":"CycloneDX","components":[{"type":"library","name":"a","hashes":[{"alg":"x"}]}]}'), (6, "[]"), (7, None),
        ],
        "doc_id int, raw string",
    ).withColumn("subject_id", F.lit("s"))
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(normalized(docs, CYCLONEDX_COMPONENTS)) == rows(evidence.cyclonedx_components(docs))


def test_documents_of_one_row_group_are_dealt_out(spark):
    docs = spark.range(400).coalesce(1).selectExpr("id AS doc_id", """concat('{"version":"1","plugins_used":[],"results":{"a', id, '":[{"type":"t"}]}}') AS raw""", "map('k', id) AS m")
    found = normalized(docs, DETECT_SECRETS, keep=("doc_id", "m"))
    assert found.where("path = concat('a', doc_id) AND m['k'] = doc_id").count() == 400
    assert "Exchange hashpartitioning" in found._jdf.queryExecution().executedPlan().toString()

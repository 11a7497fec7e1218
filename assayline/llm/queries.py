"""The queries of this subpackage over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm import code_compression, decontam, language_model, license_scan, mixing, nn_descent, quality, simhash, substring_dedup, suffix_dedup, toxicity, url_filter, whitening
from assayline.llm.common import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH cut AS (
  SELECT page_id,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS raw,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), hosts AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM cut
), ruled AS (
  SELECT page_id, host, path,
         CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
              WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
              WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
              WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule
  FROM hosts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(host || path, '(^|[.-])(spam-farm\.|cheap-pills\.|casino[.-])') THEN 'block'
            ELSE 'allow' END AS verdict
FROM ruled
"""


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", "held_out", "score", "predicted")


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontam.judge_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    named = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return judged.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), named, "contaminated")


OP5_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP5_SQL = rf"""
WITH items AS (
  SELECT item_id, w, least(13, len(w)) AS k FROM (SELECT item_id, {OP5_WORDS} AS w FROM benchmark) WHERE len(w) > 0
), phrases AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM items)
), sizes AS (
  SELECT DISTINCT k FROM phrases
), docs AS (
  SELECT doc_id, {OP5_WORDS} AS w FROM documents
), windows AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, sizes WHERE len(w) >= k)
), hits AS (
  SELECT doc_id, i, k, item_id FROM windows JOIN phrases USING (k, phrase)
), hit_words AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, k)) AS j FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", "held_out", "score", "predicted")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(table(spark, sf_dir, "embeddings"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


WORDS_SQL = r"""list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"""

REPEATS_SQL = r"""
WITH words AS (
  SELECT doc_id, WORDS AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + LENGTH - 1], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - LENGTH + 2)) AS i FROM words WHERE len(w) >= LENGTH)
), late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, i + j AS pos FROM late, range(0, LENGTH) AS t(j)
), lost AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
), tokens AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM words
), stay AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM tokens ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN lost USING (doc_id) LEFT JOIN stay USING (doc_id)
""".replace("WORDS", WORDS_SQL)
OP10_SQL, OP7_SQL = REPEATS_SQL.replace("LENGTH", "20"), REPEATS_SQL.replace("LENGTH", "50")



def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_compression.coded(table(spark, sf_dir, "embeddings"))


def _op11_sql() -> str:
    """The rounds of the quantiser one after another; products of integers are exact in doubles."""
    steps = [r"""
kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * 1024)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), pieces AS MATERIALIZED (
  SELECT rid, p, x[p * (len(x) // 4) + 1 : (p + 1) * (len(x) // 4)] AS y FROM kept, range(4) AS t(p)
), measured AS MATERIALIZED (
  SELECT *, list_inner_product(y, y) AS yy FROM pieces
), b0 AS MATERIALIZED (
  SELECT p, e, y, yy FROM measured JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id, x) - 1 AS e FROM kept ORDER BY vec_id, x LIMIT 256) USING (rid)
)"""]
    for i in range(5):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT rid, p, min((d, e)) AS best FROM (SELECT m.rid, m.p, b.e, m.yy + b.yy - 2 * list_inner_product(m.y, b.y) AS d FROM measured m JOIN b{i} b USING (p)) GROUP BY rid, p
)""")
        if i < 4:
            steps.append(f"""
s{i} AS MATERIALIZED (
  SELECT p, best[2] AS e, j, floor(sum(v) / count(*)) AS v FROM (SELECT a.p, a.best, unnest(range(len(y))) AS j, unnest(y) AS v FROM a{i} a JOIN pieces USING (rid, p)) GROUP BY ALL
), n{i} AS MATERIALIZED (
  SELECT p, e, list(v ORDER BY j) AS y FROM s{i} GROUP BY p, e
), b{i + 1} AS MATERIALIZED (
  SELECT p, e, y, list_inner_product(y, y) AS yy FROM (SELECT b.p, b.e, coalesce(n.y, b.y) AS y FROM b{i} b LEFT JOIN n{i} n USING (p, e))
)""")
    return f"""
WITH {','.join(steps)}, book AS (
  SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM (SELECT p, e, unnest(range(len(y))) AS j, unnest(y) AS v FROM b4)
), done AS (
  SELECT rid, string_agg(lpad(lower(to_hex(best[2])), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM a4 GROUP BY rid
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN done USING (rid), book
"""


OP11_SQL = _op11_sql()


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("places")


def _op12_sql() -> str:
    """Every template against every text: words that agree at the same relative position, counted."""
    rows = [
        f"({t}, '{x.label}', {x.base}, {len(x.words)}, {len(x.key_words)}, {j}, '{w}', {x.key_at <= j < x.key_at + len(x.key_words)})"
        for t, x in enumerate(license_scan.TEMPLATES)
        for j, w in enumerate(x.words)
    ]
    return rf"""
WITH t(t, label, base, n, k, j, w, key) AS (VALUES {', '.join(rows)}),
docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {OP5_WORDS} AS ws FROM documents),
words AS (SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM docs),
agreed AS (SELECT rid, t, label, base, i - j AS start, count(*) / n AS part FROM words JOIN t USING (w) GROUP BY rid, t, label, base, n, k, i - j HAVING count(*) / n >= {license_scan.SHARE} AND count(*) FILTER (key) = k),
found AS (
  SELECT rid, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, max(part) AS score,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM agreed GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM docs LEFT JOIN found USING (rid)
"""


OP12_SQL = _op12_sql()


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_quality": op2_quality,
    "op3_language_model": op3_language_model,
    "op4_mix_sources": op4_mix_sources,
    "op5_decontamination": op5_decontamination,
    "op6_toxicity": op6_toxicity,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_nearest": op8_nearest,
    "op9_simhash": op9_simhash,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_license_scan": op12_license_scan,
    "op13_whitening": op13_whitening,
}
ORACLES = {"op1_url_filter": OP1_SQL, "op5_decontamination": OP5_SQL, "op7_suffix_dedup": OP7_SQL, "op10_substring_dedup": OP10_SQL, "op11_vector_codes": OP11_SQL, "op12_license_scan": OP12_SQL}

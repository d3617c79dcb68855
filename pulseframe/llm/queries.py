"""One query per operator, with the settings of production, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulseframe.llm import op1_lines, op2_simhash, op3_decontamination, op4_licenses, op5_mixing, op6_fingerprints, op7_substrings, op8_sharding, op9_quality, op10_toxicity, op11_bpe, op12_search, op13_negatives
from pulseframe.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_line_dedup(spark, folder):
    return op1_lines.report(read(spark, folder, "documents"))


CHECKS["op1_line_dedup"] = r"""
WITH l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS spot, len(lines) AS n_lines
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
  f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY spot) AS n,
      count(*) OVER (PARTITION BY doc_id) = 1 OR len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) > 50 AS alone,
      lead(line) OVER (PARTITION BY doc_id ORDER BY spot) AS line2
    FROM l WHERE NOT regexp_full_match(line, '[\x20\x09-\x0D]*')),
  w AS (SELECT doc_id, n, row_number() OVER (PARTITION BY line, line2 ORDER BY doc_id, n) AS place FROM f WHERE line2 IS NOT NULL),
  o AS (SELECT doc_id, n, alone, row_number() OVER (PARTITION BY line ORDER BY doc_id, n) AS place FROM f),
  g AS (SELECT doc_id, unnest([n, n + 1]) AS n FROM w WHERE place > 1 UNION SELECT doc_id, n FROM o WHERE place > 1 AND alone),
  r AS (SELECT f.*, g.n IS NOT NULL AS gone FROM f LEFT JOIN g ON f.doc_id = g.doc_id AND f.n = g.n),
  s AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (gone AND NOT coalesce(before, false)) AS n_runs
    FROM (SELECT *, lag(gone) OVER (PARTITION BY doc_id ORDER BY n) AS before FROM r) GROUP BY doc_id),
  k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY spot) AS kept
    FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = l.doc_id AND r.spot = l.spot AND gone) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  coalesce(n_runs, 0) AS n_runs, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN s USING (doc_id) LEFT JOIN k USING (doc_id)"""


@query
def op2_simhash_near_dedup(spark, folder):
    return op2_simhash.report(read(spark, folder, "documents"))


@query
def op3_benchmark_decontamination(spark, folder):
    return op3_decontamination.report(read(spark, folder, "documents"), read(spark, folder, "benchmark")).drop("matches")


CHECKS["op3_benchmark_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
  b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win
    FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, least(13, len(w)) AS k FROM b WHERE len(w) > 0))),
  dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
    FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
  m AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, win)),
  h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
  t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


@query
def op5_source_mixing(spark, folder):
    found = op5_mixing.mix_report(read(spark, folder, "documents"))
    return found.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


@query
def op8_sharding_tree(spark, folder):
    tree = op8_sharding.topology(40)
    found = op8_sharding.shard(read(spark, folder, "documents").select("doc_id", "text"), tree, op8_sharding.grow(tree))
    return found.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query
def op9_quality_classifier(spark, folder):
    return op9_quality.report(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query
def op10_toxicity_segments(spark, folder):
    return op10_toxicity.report(read(spark, folder, "documents"), read(spark, folder, "labels")).drop("passages")


@query
def op4_license_scan(spark, folder):
    return op4_licenses.report(read(spark, folder, "documents"))


CHECKS["op4_license_scan"] = op4_licenses.SQL


@query
def op7_substring_dedup(spark, folder):
    return op7_substrings.report(read(spark, folder, "documents"))


@query
def op6_document_fingerprints(spark, folder):
    return op6_fingerprints.report(read(spark, folder, "documents"))


@query
def op11_bpe_codec(spark, folder):
    return op11_bpe.report(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op12_lexical_search(spark, folder):
    return op12_search.search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


CHECKS["op12_lexical_search"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
  q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
  c AS (SELECT count(*) AS big_n, CAST(sum(len(w)) AS BIGINT) AS big_l FROM d WHERE len(w) > 0),
  t AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d)
    WHERE term IN (SELECT term FROM q) GROUP BY ALL),
  f AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, c GROUP BY term),
  s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l)))) AS BIGINT) AS score
    FROM t JOIN f USING (term) JOIN q USING (term), c GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10"""


@query
def op13_hard_negatives(spark, folder):
    vectors = read(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return op13_negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)


CHECKS["op13_hard_negatives"] = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""

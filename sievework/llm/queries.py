"""The registered queries of this subpackage, and SQL for those that DuckDB can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievework.llm import bpe_automaton, huffman_ids, langid, merkle_manifest, oracle, pii_feistel, pivot_codes, quality_mcd, secret_scan, simhash_covering, substring_rlz, url_equivalence, vector_packing, winnowing
from sievework.llm.common import shared_dir

#: Key of the registered PII query; a real run passes one of its own.
DEMO_KEY = "not-a-secret"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_secrets(_table(spark, sf_dir, "documents")))


def op2_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mcd.digest(quality_mcd.quality(_table(spark, sf_dir, "documents")))


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.digest(winnowing.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op4_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_covering.digest(simhash_covering.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, radius=3))


def op5_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.round_trip(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_langid_marginal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op7_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.digest(vector_packing.pack(_table(spark, sf_dir, "documents"), 8))


def op8_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_feistel.find_and_replace(_table(spark, sf_dir, "documents"), DEMO_KEY)


def op9_url_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_equivalence.judge(_table(spark, sf_dir, "pages"))


def op10_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/sievework-huffman-{uuid.uuid4().hex}"
    huffman_ids.store(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), path)
    return huffman_ids.digest(huffman_ids.read_ids(spark, path))


def op11_laesa_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_codes.digest(_table(spark, sf_dir, "embeddings"))


def op12_substring_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_rlz.digest(substring_rlz.remove_repeats(_table(spark, sf_dir, "documents")))


def op13_merkle_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.digest(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_quality_mcd, op3_winnowing, op4_simhash_covering, op5_bpe_automaton, op6_langid_marginal, op7_vector_packing, op8_pii_feistel, op9_url_equivalence, op10_huffman_ids,
        op11_laesa_codes, op12_substring_rlz, op13_merkle_intervals,
    )
}

#: Components as reachable pairs of a recursive query: fine for the few links of a test table, not for a large one.
_OP9_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^#]*)', 1, 's') AS rest
  FROM pages
), rules(verdict, h, pre) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), urls AS (
  SELECT DISTINCT host, path, host || rest AS key FROM p WHERE host <> ''
), links AS (
  SELECT host || rest AS a, html, host, path,
         unnest([regexp_extract(html, '<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'is'),
                 regexp_extract(html, '<link\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)[^>]*\brel\s*=\s*["'']?canonical\b', 1, 'is'),
                 regexp_extract(html, '<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\bcontent\s*=\s*["'']?\s*[0-9.]*\s*[;,]?\s*url\s*=\s*["'']?([^"''\s>]+)', 1, 'is')]) AS link
  FROM p WHERE host <> ''
), cut AS (
  SELECT *, regexp_extract(l, '^[^?#]*', 0, 's') AS name, regexp_extract(l, '^[^?#]*(.*)$', 1, 's') AS more, regexp_extract(path, '^.*/', 0, 's') AS place
  FROM (SELECT a, host, path, replace(link, '&amp;', '&') AS l FROM links WHERE link <> '')
), full_path AS (
  SELECT *, CASE WHEN starts_with(l, '/') THEN name ELSE CASE WHEN place = '' THEN '/' ELSE place END || name END AS f FROM cut
), folded AS (
  SELECT *, '/' || array_to_string(list_reduce([[]::VARCHAR[]] || list_transform(string_split(regexp_replace(substr(f, 2), '(^|/)(\.\.?)$', '\1\2/'), '/'), lambda x: [x]),
    lambda acc, x: CASE WHEN x[1] = '.' THEN acc WHEN x[1] = '..' THEN acc[1 : greatest(len(acc) - 1, 0)] ELSE acc || x END), '/') AS g FROM full_path
), whole AS (
  SELECT a, CASE WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN l WHEN starts_with(l, '//') THEN 'http:' || l
      WHEN starts_with(l, '/') THEN 'http://' || host || CASE WHEN regexp_matches(name, '/\.\.?(/|$)') THEN g ELSE name END || more
      WHEN starts_with(l, '?') THEN 'http://' || host || path || l
      WHEN NOT regexp_matches(l, '^([A-Za-z][A-Za-z0-9+.-]*:|#)') THEN 'http://' || host || g || more END AS u FROM folded
), ends AS (
  SELECT a, translate(regexp_extract(u, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS bh,
         regexp_extract(u, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS bp, regexp_extract(u, '^.*?://[^/?#]*([^#]*)', 1, 's') AS br
  FROM whole WHERE u IS NOT NULL
), edges AS (
  SELECT a, bh || br AS b FROM ends WHERE bh <> '' UNION SELECT bh || br, a FROM ends WHERE bh <> ''
), reach(a, b) AS (
  SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a
), named AS (
  SELECT host, path, key FROM urls UNION SELECT bh, bp, bh || br FROM ends WHERE bh <> ''
), ruled AS (
  SELECT n.key, n.host, n.path, arg_max(r.verdict, length(r.h || r.pre)) AS verdict, arg_max(r.h || r.pre, length(r.h || r.pre)) AS rule
  FROM named n JOIN rules r ON (n.host = r.h OR ends_with(n.host, '.' || r.h)) AND starts_with(n.path, r.pre) GROUP BY ALL
), bad AS (
  SELECT DISTINCT reach.a AS key FROM reach JOIN ruled ON ruled.key = reach.b AND ruled.verdict = 'block'
)
SELECT p.page_id, p.host, p.path, ruled.rule AS rule, coalesce(ruled.verdict, CASE WHEN bad.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN ruled ON p.host <> '' AND ruled.key = p.host || p.rest AND ruled.host = p.host AND ruled.path = p.path
LEFT JOIN bad ON p.host <> '' AND bad.key = p.host || p.rest
"""

ORACLE_SQL: dict[str, str] = {
    "op9_url_equivalence": _OP9_SQL, "op11_laesa_codes": oracle.pivot_codes(), "op12_substring_rlz": oracle.substring(), "op13_merkle_intervals": oracle.merkle(),
}

"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.decontaminate import op10_decontaminate
from ledgerloom.llm.hamerly import op12_centroid_clustering
from ledgerloom.llm.hard_negatives import op13_hard_negatives
from ledgerloom.llm.language_id import op2_language_id
from ledgerloom.llm.license_scan import op11_license_scan
from ledgerloom.llm.minhash import op5_minhash
from ledgerloom.llm.packing import op7_packing
from ledgerloom.llm.pii import op9_pii
from ledgerloom.llm.quality import op6_quality
from ledgerloom.llm.secret_scan import op1_secret_scan
from ledgerloom.llm.suffix_dedup import op3_suffix_dedup
from ledgerloom.llm.token_counts import op8_token_counts
from ledgerloom.llm.token_store import op4_token_store
from ledgerloom.llm.vector_sql import NEGATIVES_SQL, clustering_sql


def secret_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can count of operator 1: its spans by fixed patterns."""
    return op1_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can count of operator 6: the base features and the base test."""
    return op6_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = {
    "secret_base": secret_base,
    "quality_base": quality_base,
    "op1_secret_scan": op1_secret_scan,
    "op2_language_id": op2_language_id,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_token_store": op4_token_store,
    "op5_minhash": op5_minhash,
    "op6_quality": op6_quality,
    "op7_packing": op7_packing,
    "op8_token_counts": op8_token_counts,
    "op9_pii": op9_pii,
    "op10_decontaminate": op10_decontaminate,
    "op11_license_scan": op11_license_scan,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_hard_negatives": op13_hard_negatives,
}

#: In either case, letter by letter: DuckDB's flag would fold letters beyond ASCII too.
ANY_CASE = "".join(f"[{c.upper()}{c}]" for c in "password") + "|" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else "_?" for c in w) for w in ("passwd", "secret", "token", "api_key"))

#: Tokenizers, compression, fingerprints, keyed draws and expectation-maximisation are beyond SQL: the other
#: operators are tested against libraries and brute force.
ORACLE_SQL: dict[str, str] = {
    "secret_base": rf"""SELECT doc_id, CAST(len(list_filter(regexp_extract_all(t, '({ANY_CASE})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS BIGINT) AS n_access, CAST(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 32)) AS BIGINT) AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "quality_base": r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
  l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
  i AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS k, w FROM w WHERE len(w) >= 8),
  n AS (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, w[k:k + 7]) AS c FROM i),
  r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(k, k + 8)) AS word FROM n WHERE c > 1) GROUP BY 1)
SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(n, 0) > 30 * len(w) AS base_failed
FROM l LEFT JOIN r ON l.doc_id = r.doc_id""",
    "op5_minhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
  e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
  u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
  r AS (SELECT DISTINCT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.reached),
  m AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)""",
    "op12_centroid_clustering": clustering_sql(),
    "op13_hard_negatives": NEGATIVES_SQL,
}

"""The corpus queries by name, and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, fingerprint, html, langid, minhash, negatives, pii, sharding, substrings, topk, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_near_dedup": minhash.query,
    "op2_language_id": langid.predict_query,
    "op3_fingerprints": fingerprint.query,
    "op4_html_extraction": html.query,
    "op5_substring_dedup": substrings.query,
    "op6_warc": warc.query,
    "op7_decontamination": decontaminate.query,
    "op8_byte_bpe": bpe.query,
    "op9_sharding": sharding.query,
    "op10_pii": pii.query,
    "op11_embedding_whitening": whitening.query,
    "op12_hard_negatives": negatives.query,
    "op13_exact_topk": topk.query,
}

_OP5 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM starts
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth FROM windows) WHERE nth > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS pos FROM later, range(0, 20) AS r(k)
), words AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM d
), kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.pos) AS text
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.pos = words.pos
  WHERE gone.pos IS NULL GROUP BY words.doc_id
), counts AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(counts.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN counts ON counts.doc_id = d.doc_id
"""

_OP6 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages
), q AS (
  SELECT page_id, n, h, min(page_id) OVER (PARTITION BY h) AS first_id FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, CAST(i // 4 AS INTEGER) * 5 + 1, 5) AS INTEGER) >> CAST(5 * (3 - i % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM q
"""

_VECTORS = """
WITH e AS (
  SELECT vec_id, {label} AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL
), x AS (
  SELECT vec_id, label, list_transform(v, lambda c: floor({factor} * c)) AS x FROM e
  WHERE len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0
)
"""

_OP12 = (
    _VECTORS.format(factor=256, label="CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    + """, known AS (
  SELECT * FROM x WHERE label IS NOT NULL
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS alike, c.vec_id AS vec_id, CAST(list_inner_product(a.x, c.x) AS BIGINT) AS score
  FROM known AS a JOIN known AS c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives AS p JOIN scored AS s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5
"""
)

_OP13 = (
    _VECTORS.format(factor=64, label="NULL")
    + """, scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM x AS q JOIN x AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 20
"""
)

ORACLE_SQL: dict[str, str] = {"op5_substring_dedup": _OP5, "op6_warc": _OP6, "op12_hard_negatives": _OP12, "op13_exact_topk": _OP13}

"""The registered corpus queries and the SQL that checks them, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op10_decontaminate
from .html import op1_html_extract
from .images import op4_image_copies
from .jaccard import op8_jaccard_join
from .language import op9_language_id
from .lm import op2_lm_score
from .mixing import op3_mix_sources
from .negatives import OP12_SQL, op12_hard_negatives
from .pii import op5_pii
from .spelling import OP13_SQL, op13_spelling_variants
from .substrings import OP7_SQL, op7_substring_dedup
from .urls import OP6_SQL, op6_url_filter
from .warc import OP11_SQL, op11_warc_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": op1_html_extract,
    "op2_lm_score": op2_lm_score,
    "op3_mix_sources": op3_mix_sources,
    "op4_image_copies": op4_image_copies,
    "op5_pii": op5_pii,
    "op6_url_filter": op6_url_filter,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_language_id": op9_language_id,
    "op10_decontaminate": op10_decontaminate,
    "op11_warc_index": op11_warc_index,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_spelling_variants": op13_spelling_variants,
}

OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents
), every AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM w
), triple AS (
  SELECT doc_id, word || ' ' || lead(word, 1) OVER own || ' ' || lead(word, 2) OVER own AS g
  FROM every WINDOW own AS (PARTITION BY doc_id ORDER BY p)
), s AS (
  SELECT DISTINCT doc_id, g FROM triple WHERE g IS NOT NULL
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) IN (1, 2)
), sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT reach.doc_id, l.y FROM reach JOIN both_ways l ON reach.r = l.x
)
SELECT reach.doc_id, CAST(coalesce(max(n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id
FROM reach LEFT JOIN sizes ON sizes.doc_id = reach.doc_id GROUP BY reach.doc_id
"""

SQL: dict[str, str] = {
    "op6_url_filter": OP6_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op8_jaccard_join": OP8_SQL,
    "op11_warc_index": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_spelling_variants": OP13_SQL,
}

"""SQL for the results of those operators that SQL can express."""

from __future__ import annotations

#: every window of 50 words that stood before, with neighbours that continue each other here and at their first place made one
REPEATED_PASSAGES = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10ffff}]+') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
placed AS (SELECT doc_id, ws, unnest(range(len(ws) - 49)) AS pos FROM w WHERE len(ws) >= 50),
win AS (SELECT doc_id, pos, md5(array_to_string(ws[pos + 1:pos + 50], ' ')) AS key FROM placed),
seen AS (SELECT doc_id, pos, first_value(doc_id) OVER o AS fd, first_value(pos) OVER o AS fp FROM win WINDOW o AS (PARTITION BY key ORDER BY doc_id, pos)),
again AS (SELECT *, pos > lag(pos) OVER r + 50 AS apart FROM seen WHERE (doc_id, pos) <> (fd, fp) WINDOW r AS (PARTITION BY doc_id, fd, fp - pos ORDER BY pos)),
runs AS (SELECT *, sum(coalesce(apart, false)::INT) OVER (PARTITION BY doc_id, fd, fp - pos ORDER BY pos) AS run FROM again)
SELECT doc_id, min(pos) AS start_word, max(pos) + 50 AS end_word, fd AS first_doc_id, min(fp) AS first_start_word FROM runs GROUP BY doc_id, fd, fp - pos, run
"""

-- uses: statute glossary proposals
WITH held AS (SELECT doc_id FROM documents UNION ALL SELECT -doc_id - 1 FROM documents)
SELECT h.doc_id,
       CASE WHEN c.n IS NULL THEN 'unavailable' WHEN coalesce(e.n, 0) > 500 THEN 'partial' ELSE 'complete' END AS status,
       coalesce(e.n, 0) AS explicit_detected, least(coalesce(e.n, 0), 500) AS explicit_returned,
       coalesce(r.n, 0) AS implicit_returned, coalesce(g.n, 0) AS generic_rejected,
       'LLM_NOT_CONFIGURED' || CASE WHEN coalesce(e.n, 0) > 500 THEN '|TERM_LIMIT_EXCEEDED' ELSE '' END
         || CASE WHEN c.n IS NULL THEN '|NO_USABLE_TEXT' ELSE '' END AS warnings
FROM held h
LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1) c USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM defined GROUP BY 1) e USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM ranked_terms GROUP BY 1) r USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM judged WHERE verdict = 'rejected' GROUP BY 1) g USING (doc_id)

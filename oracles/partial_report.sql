-- uses: statute glossary summaries raised
SELECT d.doc_id, 'file' || d.doc_id || '.docx' AS file_name, coalesce(pc.n, 1) AS page_count,
       p1.chunk_id AS context_ids, p4.chunk_id AS impact_ids, t.terms, coalesce(q.n, 0) AS question_count,
       p4.chunk_id IS NOT NULL AS sections_complete, CASE WHEN c.n IS NULL THEN 'unavailable' ELSE 'partial' END AS terminology_status,
       'LLM_NOT_CONFIGURED' || CASE WHEN c.n IS NULL THEN '|NO_USABLE_TEXT' ELSE '' END AS warnings,
       'terminology_partial' AS generation_mode, 'pending' AS enrichment_status
FROM documents d
LEFT JOIN (SELECT doc_id, max(1 + (r - 1) // 6) AS n FROM placed_lines GROUP BY 1) pc ON pc.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1) c ON c.doc_id = d.doc_id
LEFT JOIN (SELECT * FROM picks WHERE section = 'context') p1 ON p1.doc_id = d.doc_id
LEFT JOIN (SELECT * FROM picks WHERE section = 'impact') p4 ON p4.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, string_agg(term, '|' ORDER BY pos) AS terms FROM defined WHERE pos <= 500 GROUP BY 1) t ON t.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, count(*) AS n FROM raised WHERE nth <= 5 GROUP BY 1) q ON q.doc_id = d.doc_id

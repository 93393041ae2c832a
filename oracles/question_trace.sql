-- uses: statute asking ranking supporting
WITH RECURSIVE law_questions AS (SELECT q_id, doc_id, question FROM questions),
--shared identity
SELECT q.q_id, i.identifier IS NULL AND (coalesce(i.refused, false) OR s.q_id IS NULL) AS insufficient_evidence,
       md5(CASE WHEN i.identifier IS NOT NULL THEN c.text WHEN coalesce(i.refused, false) THEN '' ELSE coalesce(r.context, '') END) AS context_digest,
       CASE WHEN i.identifier IS NOT NULL THEN '0.0' WHEN coalesce(i.refused, false) THEN '' ELSE coalesce(r.zeros, '') END AS scores
FROM questions q LEFT JOIN identity i USING (q_id) LEFT JOIN sources s USING (q_id)
LEFT JOIN chunks c ON c.doc_id = q.doc_id AND c.chunk_id = i.identity_chunk
LEFT JOIN (SELECT q_id, string_agg(text, chr(10) ORDER BY rank) AS context, string_agg('0.0', '|') AS zeros FROM ranked GROUP BY 1) r USING (q_id)

-- uses: statute asking ranking supporting
WITH RECURSIVE law_questions AS (SELECT q_id, doc_id, question FROM questions),
--shared identity
SELECT q.q_id,
       CASE WHEN i.identifier IS NOT NULL THEN i.identifier
            WHEN coalesce(i.refused, false) OR s.q_id IS NULL THEN 'Không đủ thông tin trong tài liệu để trả lời.'
            ELSE s.answer END AS answer,
       CASE WHEN i.identifier IS NOT NULL THEN i.identity_chunk
            WHEN coalesce(i.refused, false) OR s.q_id IS NULL THEN '' ELSE s.chunk_ids END AS citation_ids,
       CASE WHEN i.identifier IS NOT NULL THEN 1.0
            WHEN coalesce(i.refused, false) OR s.q_id IS NULL THEN 0.0 ELSE round(least(1.0, mean_lexical), 6) END AS confidence,
       i.identifier IS NULL AND (coalesce(i.refused, false) OR s.q_id IS NULL) AS out_of_scope,
       CASE WHEN coalesce(i.refused, false) THEN 'invalid identity citation' ELSE '' END AS invalid_reasons,
       CASE WHEN i.identifier IS NOT NULL THEN i.identity_chunk WHEN coalesce(i.refused, false) THEN ''
            ELSE coalesce(r.ids, '') END AS retrieved_ids
FROM questions q LEFT JOIN identity i USING (q_id) LEFT JOIN sources s USING (q_id)
LEFT JOIN (SELECT q_id, string_agg(chunk_id, '|' ORDER BY rank) AS ids FROM ranked GROUP BY 1) r USING (q_id)

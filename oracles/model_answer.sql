-- uses: statute excerpts asking ranking supporting
WITH RECURSIVE law_questions AS (SELECT q_id, doc_id, question FROM questions),
--shared identity,
proposals AS (
  SELECT doc_id AS q_id, chunk_id, CASE WHEN doc_id % 4 = 0 THEN text || ' zzz' ELSE '“' || lower(text) || '”' END AS said, doc_id % 5 = 0 AS stray
  FROM chunks QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY md5(chunk_id || '-' || doc_id) DESC) = 1),
judged_models AS (
  SELECT p.q_id, p.chunk_id, said, stray,
         EXISTS (SELECT 1 FROM ranked r WHERE r.q_id = p.q_id AND r.chunk_id = p.chunk_id) AS seen,
         EXISTS (SELECT 1 FROM supported s WHERE s.q_id = p.q_id AND s.supported AND s.chunk_id = p.chunk_id
                 AND contains(trim(regexp_replace(replace(lower(s.text), 'ß', 'ss'), '\s+', ' ', 'g'), '"“”‘’'' '),
                              trim(regexp_replace(replace(lower(said), 'ß', 'ss'), '\s+', ' ', 'g'), '"“”‘’'' '))) AS quotes
  FROM proposals p),
verdicts AS (
  SELECT *, NOT stray AND seen AND quotes AS usable,
         CASE WHEN NOT stray AND seen THEN CASE WHEN quotes THEN '' ELSE 'LLM response missing answer or citations' END
              ELSE concat_ws('|', CASE WHEN NOT seen THEN 'citation not retrieved: ' || chunk_id END, CASE WHEN stray THEN 'unknown citation ID: X' END) END AS why
  FROM judged_models)
SELECT q.q_id,
       CASE WHEN i.identifier IS NOT NULL THEN i.identifier WHEN coalesce(i.refused, false) OR s.q_id IS NULL THEN 'Không đủ thông tin trong tài liệu để trả lời.'
            WHEN v.usable THEN said ELSE s.answer END AS answer,
       CASE WHEN i.identifier IS NOT NULL THEN i.identity_chunk WHEN coalesce(i.refused, false) OR s.q_id IS NULL THEN ''
            WHEN v.usable THEN v.chunk_id ELSE s.chunk_ids END AS citation_ids,
       CASE WHEN i.identifier IS NOT NULL THEN 1.0 WHEN coalesce(i.refused, false) OR s.q_id IS NULL THEN 0.0 WHEN v.usable THEN 1.0
            ELSE round(least(1.0, mean_lexical), 6) END AS confidence,
       CASE WHEN i.identifier IS NOT NULL THEN '' WHEN coalesce(i.refused, false) THEN 'invalid identity citation'
            WHEN s.q_id IS NULL OR v.usable THEN '' ELSE coalesce(why, '') END AS invalid_reasons
FROM questions q LEFT JOIN identity i USING (q_id) LEFT JOIN sources s USING (q_id) LEFT JOIN verdicts v USING (q_id)

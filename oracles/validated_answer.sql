-- uses: statute excerpts asking ranking supporting
WITH RECURSIVE law_questions AS (SELECT q_id, doc_id, question FROM questions),
--shared identity,
sound_identity AS (
  SELECT q_id, CASE WHEN NOT bad THEN identifier END AS identifier, CASE WHEN NOT bad THEN identity_chunk END AS identity_chunk, refused OR bad AS refused
  FROM (SELECT i.*, i.identifier IS NOT NULL AND ((q.doc_id % 11 = 5 AND c.article IS DISTINCT FROM 'Điều 0')
               OR (q.doc_id % 7 = 3 AND NOT starts_with(lower(c.text), 'x '))) AS bad
        FROM identity i JOIN questions q USING (q_id) LEFT JOIN chunks c ON c.doc_id = q.doc_id AND c.chunk_id = i.identity_chunk)),
checked AS (
  SELECT s.q_id, s.page, s.chunk_id, s.sentence, s.lexical,
         CASE WHEN s.doc_id % 11 = 5 AND c.article IS DISTINCT FROM 'Điều 0' THEN 'inconsistent citation metadata: ' || s.chunk_id
              WHEN s.doc_id % 7 = 3 AND NOT starts_with(lower(c.text), 'x ') THEN 'inconsistent citation excerpt: ' || s.chunk_id END AS reason
  FROM selected s JOIN chunks c ON c.doc_id = s.doc_id AND c.chunk_id = s.chunk_id),
verdict AS (
  SELECT q_id, coalesce(string_agg(reason, '|' ORDER BY page, chunk_id), '') AS reasons,
         coalesce(string_agg(chunk_id, '|' ORDER BY page, chunk_id) FILTER (reason IS NULL), '') AS ids, count(reason) = 0 AS ok
  FROM checked GROUP BY 1)
SELECT q.q_id,
       CASE WHEN i.identifier IS NOT NULL THEN i.identifier WHEN coalesce(i.refused, false) OR s.q_id IS NULL OR NOT v.ok
            THEN 'Không đủ thông tin trong tài liệu để trả lời.' ELSE s.answer END AS answer,
       CASE WHEN i.identifier IS NOT NULL THEN i.identity_chunk WHEN coalesce(i.refused, false) OR s.q_id IS NULL OR NOT v.ok THEN '' ELSE v.ids END AS citation_ids,
       i.identifier IS NULL AND (coalesce(i.refused, false) OR s.q_id IS NULL OR NOT v.ok) AS out_of_scope,
       CASE WHEN i.identifier IS NOT NULL THEN '' WHEN coalesce(i.refused, false) THEN 'invalid identity citation' WHEN s.q_id IS NULL THEN '' ELSE v.reasons END AS invalid_reasons
FROM questions q LEFT JOIN sound_identity i USING (q_id) LEFT JOIN sources s USING (q_id) LEFT JOIN verdict v USING (q_id)

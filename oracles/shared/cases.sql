answered AS (
  SELECT q.q_id, CASE WHEN i.identifier IS NOT NULL THEN [i.identity_chunk] WHEN coalesce(i.refused, false) OR s.q_id IS NULL THEN []
                 ELSE string_split(s.chunk_ids, '|') END AS cited,
         CASE WHEN i.identifier IS NOT NULL THEN [i.identity_chunk] WHEN coalesce(i.refused, false) THEN [] ELSE coalesce(r.ids, []) END AS retrieved,
         i.identifier IS NULL AND (coalesce(i.refused, false) OR s.q_id IS NULL) AS insufficient
  FROM questions q LEFT JOIN identity i USING (q_id) LEFT JOIN sources s USING (q_id)
  LEFT JOIN (SELECT q_id, list(chunk_id ORDER BY rank) AS ids FROM ranked GROUP BY 1) r USING (q_id)),
golden AS (
  SELECT c.doc_id, list(c.chunk_id) AS gold
  FROM chunks c JOIN (SELECT doc_id, regexp_extract_all(text, '[a-z]{4,}')[1] AS leading FROM documents) w ON w.doc_id = c.doc_id
  WHERE contains(c.text, w.leading) GROUP BY 1),
cases AS (
  SELECT d.doc_id, lang, quality = 1 AS inside, cited, retrieved[1:5] AS top5,
         CASE WHEN quality = 1 THEN coalesce(gold, []) ELSE [] END AS gold, insufficient
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id JOIN answered a ON a.q_id = d.doc_id LEFT JOIN golden g ON g.doc_id = d.doc_id),
case_scores AS (
  SELECT doc_id, lang, CASE WHEN inside THEN 'in' ELSE 'out' END AS scope,
         CASE WHEN inside THEN CASE WHEN len(cited) = 0 THEN 0.0 ELSE len(list_filter(cited, lambda x: list_contains(gold, x))) / len(cited) END END AS precision,
         CASE WHEN inside AND len(gold) > 0 THEN len(list_distinct(list_filter(top5, lambda x: list_contains(gold, x)))) / len(list_distinct(gold)) END AS recall_at_5,
         CASE WHEN NOT inside THEN CASE WHEN insufficient AND len(cited) = 0 THEN 1.0 ELSE 0.0 END END AS refusal
  FROM cases)

proposed AS (
  SELECT doc_id, page * 1000 + ordinal AS pos, chunk_id, (page * 7 + ordinal * 3 + doc_id) AS k,
      CASE WHEN (page * 7 + ordinal * 3 + doc_id) % 5 = 0 THEN 'Nghĩa vụ thực hiện'
           WHEN (page * 7 + ordinal * 3 + doc_id) % 5 = 1 THEN 'xử phạt khi vi phạm'
           WHEN (page * 7 + ordinal * 3 + doc_id) % 5 = 2 THEN 'Quyết định'
           ELSE coalesce(regexp_extract_all(text, '[a-z]{4,}')[1], '') END AS term,
      CASE WHEN (page * 7 + ordinal * 3 + doc_id) % 3 = 0 THEN 'thủ tục' ELSE 'nhãn riêng' END AS label,
      CASE WHEN (page * 7 + ordinal * 3 + doc_id) % 4 = 0 THEN '' ELSE 'lý do chọn' END AS reason,
      40 + (page * 7 + ordinal * 3 + doc_id) % 61 AS salience, 30 + (page * 7 + ordinal * 3 + doc_id) % 71 AS difficulty,
      CASE WHEN (page * 7 + ordinal * 3 + doc_id) % 6 = 0 THEN '' ELSE 'giải thích' END AS note
  FROM chunks),
proofs AS (
  SELECT p.doc_id, p.pos, string_agg(c.chunk_id, '|' ORDER BY ord) AS cited_ids, string_agg(c.text, ' ' ORDER BY ord) AS evidence
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY ord) AS nth FROM (
          SELECT a.doc_id, a.pos, b.chunk_id, b.text, CASE WHEN b.chunk_id = a.chunk_id THEN 1 WHEN b.chunk_id = 'P1-D1' THEN 2 ELSE 3 END AS ord
          FROM proposed a JOIN chunks b ON b.doc_id = a.doc_id AND b.chunk_id IN (a.chunk_id, 'P1-D1', 'P1-D2'))) c
  JOIN proposed p ON p.doc_id = c.doc_id AND p.pos = c.pos
  WHERE nth <= 2 GROUP BY 1, 2),
keyed AS (
  SELECT p.*, trim(replace(lower(term), 'ß', 'ss'), ' .,:;()[]{}"''') AS key, cited_ids, evidence, replace(lower(evidence), 'ß', 'ss') AS ev
  FROM proposed p JOIN proofs USING (doc_id, pos)),
tested AS (
  SELECT k.*,
      k.key = '' OR d.key IS NOT NULL OR k.key IN ('quyết định','trách nhiệm','tác động','quốc hội','văn bản','dự thảo','nghị định','thông tư','điều','chương','mục') AS hopeless,
      contains(ev, replace(lower(k.term), 'ß', 'ss')) AND salience >= 50 AND difficulty >= 35 AND (note <> '' OR reason <> '')
      AND regexp_matches(evidence, '(?i)(^|[^\p{L}\p{N}_])(có quyền|có nghĩa vụ|nghĩa vụ|quyền|không được|cấm|bị cấm|điều kiện|thủ tục|trình tự|xử phạt|chế tài|tranh chấp|vi phạm|người lao động|người sử dụng lao động|cơ quan|tổ chức|pháp nhân|hợp đồng|thỏa ước|đại diện)([^\p{L}\p{N}_]|$)') AS fits
  FROM keyed k LEFT JOIN defined d ON d.doc_id = k.doc_id AND d.key = k.key AND d.pos <= 500),
firsts AS (SELECT *, min(CASE WHEN fits AND NOT hopeless THEN pos END) OVER (PARTITION BY doc_id, key) AS first_pos FROM tested),
judged AS MATERIALIZED (
  SELECT *, CASE WHEN hopeless OR pos > first_pos THEN 'rejected' WHEN pos = first_pos THEN 'accepted' ELSE 'dropped' END AS verdict FROM firsts),
counted AS (
  SELECT j.doc_id, j.key, count(*) FILTER (contains(replace(lower(c.text), 'ß', 'ss'), replace(lower(j.term), 'ß', 'ss'))) AS n_hits, count(*) AS n_chunks
  FROM judged j JOIN chunks c ON c.doc_id = j.doc_id WHERE verdict = 'accepted' GROUP BY 1, 2),
rated AS (
  SELECT j.*, 0.35::DOUBLE * salience + 0.30::DOUBLE * difficulty
      + 0.15::DOUBLE * CASE WHEN regexp_matches(evidence, '(?i)(^|[^\p{L}\p{N}_])(quyền|nghĩa vụ|trách nhiệm|cấm|xử phạt|tranh chấp|vi phạm)([^\p{L}\p{N}_]|$)') THEN 100 ELSE 50 END
      + 0.20::DOUBLE * least(100, round_even(100.0 * n_hits / n_chunks, 0)) AS score
  FROM judged j JOIN counted USING (doc_id, key) WHERE verdict = 'accepted'),
ranked_terms AS MATERIALIZED (
  SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY r.doc_id ORDER BY score DESC, pos) AS rank,
                        coalesce(used, 0) AS used
                 FROM rated r LEFT JOIN (SELECT doc_id, count(*) AS used FROM defined WHERE pos <= 500 GROUP BY 1) u ON u.doc_id = r.doc_id)
  WHERE rank <= least(20, 500 - used))

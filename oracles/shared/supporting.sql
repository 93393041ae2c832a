folded AS (
  SELECT *, replace(lower(question), 'ß', 'ss') AS ql, replace(lower(text), 'ß', 'ss') AS tl,
         ['là','và','của','cho','có','được','từ','nào','gì','bao','nhiêu','ai','những','các','một','trong','về','khi','này','đó','thế'] AS stops
  FROM ranked),
asked_place AS (
  SELECT *, regexp_extract(ql, '(?:^|[^\p{L}\p{N}_])điều\s+([0-9]+)(?:[^\p{L}\p{N}_]|$)', 1) AS qa,
         regexp_extract(ql, '(?:^|[^\p{L}\p{N}_])khoản\s+([0-9]+)(?:[^\p{L}\p{N}_]|$)', 1) AS qc,
         array_to_string(list_filter(regexp_extract_all(ql, '[\p{L}\p{N}_]+'), lambda x: length(x) > 1 AND NOT list_contains(stops, x)), ' ') AS q_phrase,
         array_to_string(list_filter(regexp_extract_all(tl, '[\p{L}\p{N}_]+'), lambda x: length(x) > 1 AND NOT list_contains(stops, x)), ' ') AS t_phrase
  FROM folded),
gated AS (
  SELECT *,
      (qa = '' OR coalesce(article, '') = 'Điều ' || qa
        OR regexp_matches(tl, '(^|[^\p{L}\p{N}_])điều\s+' || qa || '([^\p{L}\p{N}_]|$)'))
      AND (qc = '' OR coalesce(clause, '') = 'Khoản ' || qc
        OR regexp_matches(tl, '(^|[^\p{L}\p{N}_])khoản\s+' || qc || '([^\p{L}\p{N}_]|$)')) AS in_place,
      regexp_matches(ql, '(^|[^\p{L}\p{N}_])(điều|khoản)\s+[0-9]+') AS names_place
  FROM asked_place),
supported AS MATERIALIZED (
  SELECT *, (NOT names_place OR in_place) AND (
        (len(qt) > 1 AND contains(t_phrase, q_phrase))
        OR (names_place AND len(ov) > 0)
        OR (lexical > 0 AND len(ov) >= 2 AND (rare >= 2 OR (len(ov) >= 4 AND len(ov) / greatest(len(qt), 1) >= 0.6)))
      ) AS supported
  FROM gated),
sentenced AS (
  SELECT q_id, chunk_id, qt, text,
         unnest(string_split(regexp_replace(text, '([.!?。])\s+', '\1' || chr(1), 'g'), chr(1))) AS sentence,
         generate_subscripts(string_split(regexp_replace(text, '([.!?。])\s+', '\1' || chr(1), 'g'), chr(1)), 1) AS sp
  FROM supported),
rated_sentences AS (
  SELECT *, len(list_intersect(qt, list_distinct(regexp_extract_all(replace(lower(sentence), 'ß', 'ss'), '[\p{L}\p{N}_]+')))) AS ov
  FROM sentenced),
best AS (
  SELECT q_id, chunk_id,
         CASE WHEN max(ov) > 0 THEN arg_min(sentence, sp + 1000000 * (100000 - ov)) ELSE any_value(text) END AS sentence
  FROM rated_sentences GROUP BY 1, 2),
agency AS (
  SELECT q_id, chunk_id,
         trim(regexp_replace(
           regexp_extract(' ' || text, '[^\p{L}\p{N}_]((Sở|Bộ|UBND|HĐND|Cơ quan|Ủy ban nhân dân)(\s+([A-ZÀ-ỸĐ]|[a-zà-ỹ])[\p{L}\p{N}_À-ỹ-]*){0,6})', 1),
           '\s+(chịu|thực|quản|phân|có|là|được|đảm|kính|trình)([^\p{L}\p{N}_].*)?$', ''), ' .,;:') AS found
  FROM supported),
focus AS (
  SELECT s.q_id, s.chunk_id, coalesce(
      CASE WHEN regexp_matches(ql, 'số hiệu|số văn bản|mã quyết định|số quyết định')
           THEN nullif(regexp_extract(text, '\b([0-9]{1,5}/[0-9]{4}/[A-ZĐ][A-ZĐ0-9-]*)', 1), '') END,
      CASE WHEN regexp_matches(ql, 'ngày|thời hạn|hạn chót|deadline|khi nào')
           THEN nullif(regexp_extract(text, '\b[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}\b'), '') END,
      CASE WHEN regexp_matches(ql, 'cơ quan nào|đơn vị nào|ai chịu|ai là|ai phụ trách') THEN nullif(a.found, '') END,
      CASE WHEN regexp_matches(ql, 'bao nhiêu tiền|mức tiền|kinh phí|số tiền|mức hỗ trợ')
           THEN nullif(regexp_extract(text, '(?i)\b([0-9][0-9.,]*\s*(?:triệu|tỷ|đồng|VNĐ))(?:[^\p{L}\p{N}_]|$)', 1), '') END) AS focus
  FROM supported s JOIN agency a USING (q_id, chunk_id)),
pieces AS MATERIALIZED (
  SELECT s.q_id, s.doc_id, s.chunk_id, page, rank, lexical, ov, supported, coalesce(f.focus, b.sentence) AS sentence
  FROM supported s JOIN best b USING (q_id, chunk_id) JOIN focus f USING (q_id, chunk_id)),
backing AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY rank) AS n FROM pieces WHERE supported),
walk AS (
  SELECT q_id, n, len(ov) > 0 AS taken, CASE WHEN len(ov) > 0 THEN ov ELSE [] END AS covered, len(ov) > 0 AS any_taken
  FROM backing WHERE n = 1
  UNION ALL
  SELECT b.q_id, b.n,
         len(b.ov) > 0 AND (NOT w.any_taken OR len(list_filter(b.ov, lambda t: NOT list_contains(w.covered, t))) >= 3),
         CASE WHEN len(b.ov) > 0 AND (NOT w.any_taken OR len(list_filter(b.ov, lambda t: NOT list_contains(w.covered, t))) >= 3)
              THEN list_distinct(list_concat(w.covered, b.ov)) ELSE w.covered END,
         w.any_taken OR len(b.ov) > 0
  FROM walk w JOIN backing b ON b.q_id = w.q_id AND b.n = w.n + 1),
selected AS (
  SELECT b.* FROM backing b JOIN walk w USING (q_id, n)
  WHERE w.taken OR (b.n = 1 AND NOT EXISTS (SELECT 1 FROM walk x WHERE x.q_id = b.q_id AND x.taken))),
sources AS (
  SELECT q_id, string_agg(chunk_id, '|' ORDER BY page, chunk_id) AS chunk_ids,
         string_agg(sentence, ' ' ORDER BY page, chunk_id) AS answer, avg(lexical) AS mean_lexical
  FROM selected GROUP BY 1)

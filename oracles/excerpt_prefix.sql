WITH c AS (
  SELECT doc_id, text AS src, CASE doc_id % 4
      WHEN 0 THEN CASE WHEN length(trim(regexp_replace(text, '\s+', ' ', 'g'))) <= 220 THEN trim(regexp_replace(text, '\s+', ' ', 'g'))
           ELSE regexp_replace(rtrim(left(trim(regexp_replace(text, '\s+', ' ', 'g')), 217)), ' [^ ]*$', '') || '...' END
      WHEN 1 THEN upper(substr(text, 1, 50)) || '..…'
      WHEN 2 THEN regexp_replace(substr(text, 1, 60), '[.,]', ' ;', 'g')
      ELSE substr(text, 3, 40) END AS claim FROM documents),
n AS (
  SELECT doc_id, trim(regexp_replace(replace(lower(claim), 'ß', 'ss'), '\s+', ' ', 'g')) AS e,
         trim(regexp_replace(replace(lower(src), 'ß', 'ss'), '\s+', ' ', 'g')) AS s FROM c),
k AS (
  SELECT *, regexp_extract_all(e, '[\p{L}\p{N}_]+') AS et, regexp_extract_all(s, '[\p{L}\p{N}_]+') AS st,
         string_split(e, ' ') AS ew, string_split(s, ' ') AS sw, rtrim(rtrim(e, '.…')) AS bare FROM n)
SELECT doc_id, (bare <> '' AND starts_with(s, bare)) OR e = '' OR sw[1:len(ew)] = ew OR (len(et) > 0 AND st[1:len(et)] = et) AS leads
FROM k

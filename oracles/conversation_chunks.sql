WITH p AS (
  SELECT conv_id AS doc_id, turn + 1 AS page, unnest(string_split(text, chr(10))) AS l,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM conversations),
c AS (
  SELECT doc_id, page, pos, trim(regexp_replace(l, '\s+', ' ', 'g')) AS l FROM p
  WHERE length(trim(regexp_replace(l, '\s+', ' ', 'g'))) >= 3),
f AS (
  SELECT *, CASE WHEN regexp_matches(l, '(?i)^(((khoản|khoan) +[0-9]+|[0-9]+\.) +|[a-zđ]\) +|(chương|chuong) +[ivxlcdm0-9]+([^\p{L}\p{N}_]|$)|(mục|muc|điều|dieu) +[0-9]+[a-z]?([^\p{L}\p{N}_]|$))') THEN 1 ELSE 0 END AS h
  FROM c),
u AS (
  SELECT *, sum(CASE WHEN h = 1 OR pos = first_pos THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY pos) AS ordinal
  FROM (SELECT *, min(pos) OVER (PARTITION BY doc_id, page) AS first_pos FROM f))
SELECT doc_id, page, CAST(ordinal AS BIGINT) AS ordinal, 'P' || page || '-D' || CAST(ordinal AS BIGINT) AS chunk_id,
       string_agg(l, ' ' ORDER BY pos) AS text
FROM u GROUP BY doc_id, page, ordinal

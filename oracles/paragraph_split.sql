WITH t AS (
  SELECT doc_id, regexp_replace(CASE doc_id % 3 WHEN 0 THEN replace(text, chr(10), chr(13) || chr(10) || chr(13) || chr(10))
         WHEN 1 THEN replace(text, chr(10), chr(13)) ELSE text END, '\r\n?', chr(10), 'g') AS x FROM documents),
b AS (
  SELECT doc_id, x, list_filter(list_transform(regexp_split_to_array(x, '\n{2,}'), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p: p <> '') AS ps
  FROM t),
k AS (
  SELECT doc_id, list_filter(CASE WHEN len(ps) > 1 THEN ps
         ELSE list_transform(string_split(x, chr(10)), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))) END, lambda p: length(p) >= 3) AS ps
  FROM b)
SELECT doc_id, unnest(range(0, len(ps))) AS pos, unnest(ps) AS paragraph FROM k

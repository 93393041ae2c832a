WITH t AS (SELECT doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_\x{00C0}-\x{1EF9}]+') AS a FROM documents),
d AS (SELECT doc_id, a, list_distinct(list_filter(a, lambda x: length(x) > 1)) AS b FROM t)
SELECT doc_id, len(a) AS n_tokens, len(b) AS n_distinct, md5(array_to_string(list_sort(b), ' ')) AS digest FROM d

SELECT lang AS scope, t AS token, count(*) AS df
FROM (SELECT lang, unnest(list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_\x{00C0}-\x{1EF9}]{2,}'))) AS t FROM documents)
GROUP BY 1, 2

WITH v AS (SELECT doc_id, regexp_extract_all(text, '[a-z]{4,}') AS v, CASE WHEN doc_id % 6 = 0 THEN 4 ELSE 5 END AS k FROM documents),
w AS (SELECT doc_id, list_filter(list_transform(range(0, k), lambda q: array_to_string(list_transform(range(q + 1, len(v) + 1, k), lambda i: v[i]), '')), lambda x: x <> '') AS w FROM v),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS n FROM w),
s AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 AND n < 2 THEN 'điềugì' WHEN doc_id % 11 = 0 AND n = 3 THEN '' ELSE word END AS bare FROM u),
d AS (SELECT doc_id, count(*) = 5 AND count(DISTINCT bare) = 5 AND bool_and(bare <> '') AS valid FROM s GROUP BY 1)
SELECT documents.doc_id, coalesce(valid, false) AS valid FROM documents LEFT JOIN d USING (doc_id)

WITH w AS (SELECT doc_id, regexp_extract_all(text, '[a-z]{4,}') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS n FROM w),
s AS (SELECT doc_id, n % 4 AS section, CASE WHEN doc_id % 5 = 0 AND n < 5 THEN 'same text' ELSE word END AS said FROM u),
g AS (SELECT doc_id, section, count(*) = count(DISTINCT said) AS ok FROM s GROUP BY 1, 2),
d AS (SELECT doc_id, count(*) = 4 AND bool_and(ok) AS valid FROM g GROUP BY 1)
SELECT documents.doc_id, coalesce(valid, false) AS valid FROM documents LEFT JOIN d USING (doc_id)

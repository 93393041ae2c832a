WITH w AS (SELECT doc_id, regexp_extract_all(text, '[a-z]{4,}') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS id, generate_subscripts(w, 1) AS pos FROM w),
f AS (SELECT doc_id, id, min(pos) AS pos FROM u GROUP BY 1, 2),
g AS (SELECT doc_id, string_agg(id, '|' ORDER BY pos) AS ids FROM f GROUP BY 1)
SELECT d.doc_id, coalesce(ids, '') AS ids FROM documents d LEFT JOIN g USING (doc_id)

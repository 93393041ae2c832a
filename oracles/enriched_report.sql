-- uses: statute referring resolving
SELECT d.doc_id, CASE WHEN d.doc_id % 13 = 0 THEN 'failed' ELSE 'completed' END AS enrichment_status,
       coalesce(r.n, 0) AS n_related, r.numbers
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(document_number, '|' ORDER BY nth) AS numbers FROM related GROUP BY 1) r USING (doc_id)

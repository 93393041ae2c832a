-- uses: statute excerpts
SELECT d.doc_id, count(c.chunk_id) AS n_citations,
       md5(string_agg(c.chunk_id || ':' || c.excerpt, chr(10) ORDER BY c.page, c.chunk_id)) AS digest, count(c.chunk_id) = 0 AS bare
FROM documents d LEFT JOIN cited c ON c.doc_id = d.doc_id GROUP BY d.doc_id

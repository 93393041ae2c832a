-- uses: statute found
SELECT doc_id, string_agg(citation_ids, ',' ORDER BY citation_ids) AS allowed_ids,
       md5(string_agg('[' || citation_ids || '] (' || kind || ') ' || text, chr(10) ORDER BY pos)) AS digest
FROM found WHERE citation_ids <> '' AND text <> '' GROUP BY 1

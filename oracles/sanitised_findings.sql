-- uses: statute found
SELECT doc_id, pos, text, citation_ids,
       CASE WHEN citation_ids = '' THEN 'map finding has no valid citation IDs.' WHEN text = '' THEN 'map finding has empty text.' END AS error
FROM found

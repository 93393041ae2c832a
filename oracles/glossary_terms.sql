-- uses: statute glossary
SELECT doc_id, pos, term, explanation, array_to_string(ids, '|') AS citation_ids, 'defined_term' AS category,
       'document_definition' AS source_type
FROM defined WHERE pos <= 500

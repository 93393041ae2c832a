-- uses: statute glossary
SELECT doc_id, chunk_id, defined_at FROM in_definition

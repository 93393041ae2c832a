-- uses: statute referring
SELECT doc_id, title, number, key, chunk_id, page, context FROM kept_refs

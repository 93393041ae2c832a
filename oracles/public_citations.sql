-- uses: statute excerpts
SELECT doc_id, chunk_id, page, chapter, article, clause, excerpt FROM cited

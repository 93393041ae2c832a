-- uses: statute glossary proposals
SELECT doc_id, pos, key, verdict FROM judged

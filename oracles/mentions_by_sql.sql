-- uses: statute referring
SELECT doc_id, chunk_id, CAST(kind AS BIGINT) AS kind, CAST(pos AS BIGINT) AS "at", title, number FROM raw

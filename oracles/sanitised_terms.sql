-- uses: statute glossary proposals
SELECT doc_id, pos, term, note AS explanation, reason AS selection_reason,
       CASE WHEN chunk_id = 'P1-D1' THEN 'P1-D1|P1-D2' WHEN chunk_id = 'P1-D2' THEN 'P1-D2|P1-D1'
            WHEN chunk_id = 'P2-D1' THEN 'P2-D1|P1-D1|P1-D2' ELSE 'P1-D1|P1-D2' END AS citation_ids
FROM proposed WHERE term <> '' AND note <> '' AND reason <> ''

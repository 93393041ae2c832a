WITH cleaned AS (
  SELECT doc_id, doc_id // 50 AS file, replace(coalesce(text, ''), chr(12), ' ') AS text FROM documents),
files AS (
  SELECT file, substring(sha256(string_agg(text, chr(12) ORDER BY doc_id, text)), 1, 16) AS id FROM cleaned GROUP BY file)
SELECT id AS doc_id, 'b' || file || '.pdf' AS file_name,
       row_number() OVER (PARTITION BY file ORDER BY doc_id, text) AS page_number, md5(nfc_normalize(text)) AS digest
FROM cleaned JOIN files USING (file)

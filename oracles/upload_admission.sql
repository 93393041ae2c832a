WITH f AS (
  SELECT doc_id, 'file' || doc_id || ['.PDF', '.docx', '.txt', ''][1 + doc_id % 4] AS file_name, n_chars * 5000 AS size,
         doc_id % 4 IN (0, 1) AS good, doc_id % 6 = 2 AS pdf_mime, text FROM documents)
SELECT doc_id, file_name,
       CASE WHEN size > 26214400 THEN 'FILE_TOO_LARGE' WHEN NOT good THEN 'UNSUPPORTED_FILE' END AS error_code,
       CASE WHEN NOT (good OR pdf_mime) THEN 'Chỉ hỗ trợ PDF hoặc DOCX.' WHEN size > 26214400 THEN 'Tệp vượt quá giới hạn 25 MB.' END AS message,
       left(sha256(text), 16) AS content_id
FROM f

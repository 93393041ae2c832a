WITH lined AS (
  SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS lines, lang
  FROM documents)
SELECT CASE WHEN doc_id % 7 = 3 THEN NULL ELSE CAST(doc_id AS VARCHAR) END AS doc_id, 'd' || doc_id || CASE WHEN doc_id % 7 = 3 THEN '.txt' ELSE '.DOCX' END AS file_name,
       CASE WHEN doc_id % 7 = 3 THEN 'UNSUPPORTED_FILE' WHEN doc_id % 11 = 5 THEN 'PROCESSING_FAILED' END AS error_code,
       CASE WHEN doc_id % 7 = 3 OR doc_id % 11 = 5 THEN NULL ELSE CAST(1 AS BIGINT) END AS page_number,
       CASE WHEN doc_id % 7 = 3 OR doc_id % 11 = 5 THEN NULL ELSE md5(nfc_normalize(array_to_string(list_append(lines, '| text | ' || lang || ' |' || chr(10) || '| --- | --- |'), chr(10) || chr(10)))) END AS digest
FROM lined

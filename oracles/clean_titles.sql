SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Nghị định'
       ELSE rtrim('Nghị định số  về ' || array_to_string(regexp_extract_all(text, '[a-z]{4,}')[1:3], ' ')) END AS title
FROM documents

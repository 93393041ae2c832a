SELECT doc_id, regexp_replace(regexp_replace(
         text || ' Authorization: Bearer' || doc_id || ', API-key = k' || doc_id || ' end',
         '(?i)(api[_-]?key|token|secret|password)\s*[:=]\s*[^,\s]+', '\1=[REDACTED]', 'g'),
         '(?i)(authorization)\s*[:=]\s*[^,\s]+', '\1=[REDACTED]', 'g') AS text
FROM documents

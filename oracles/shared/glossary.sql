placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, ordinal) AS n FROM chunks),
titled AS (
  SELECT *, regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(giải\s+thích\s+từ\s+ngữ|được\s+hiểu\s+như\s+sau)([^\p{L}\p{N}_]|$)') AS is_title,
         regexp_matches(text, '(?i)^\s*điều\s+[0-9]+[a-z]?([^\p{L}\p{N}_]|$)') AS starts_article FROM placed),
regions AS (SELECT *, sum(CASE WHEN is_title THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS region FROM titled),
with_article AS (
  SELECT *, first_value(article) OVER (PARTITION BY doc_id, region ORDER BY n) AS glossary_article FROM regions WHERE region > 0),
left_yet AS (
  SELECT *, sum(CASE WHEN NOT is_title AND (starts_article OR (article IS NOT NULL AND article IS DISTINCT FROM glossary_article)) THEN 1 ELSE 0 END)
            OVER (PARTITION BY doc_id, region ORDER BY n) AS gone FROM with_article),
definitions AS (
  SELECT *, regexp_matches(text, '(?is)^\s*[0-9]{1,3}[.)]\s*(.{2,180}?)\s+(?:là|được\s+hiểu\s+là|bao\s+gồm)\s+(.+?)\s*$') AS is_definition
  FROM left_yet WHERE gone = 0),
in_region AS (
  SELECT *, sum(CASE WHEN is_definition THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, region ORDER BY n) AS def FROM definitions),
in_definition AS (
  SELECT *, first_value(page || '.' || ordinal) OVER (PARTITION BY doc_id, region, def ORDER BY n) AS defined_at
  FROM in_region WHERE def > 0),
merged AS (
  SELECT doc_id, region, def, min(n) AS n,
         trim(regexp_replace(arg_min(regexp_extract(text, '(?is)^\s*[0-9]{1,3}[.)]\s*(.{2,180}?)\s+(?:là|được\s+hiểu\s+là|bao\s+gồm)\s+(.+?)\s*$', 1), n), '\s+', ' ', 'g')) AS term,
         string_agg(CASE WHEN is_definition THEN regexp_extract(text, '(?is)^\s*[0-9]{1,3}[.)]\s*(.{2,180}?)\s+(?:là|được\s+hiểu\s+là|bao\s+gồm)\s+(.+?)\s*$', 2) ELSE text END, ' ' ORDER BY n) AS explanation,
         list(chunk_id ORDER BY n)[1:2] AS ids
  FROM in_definition GROUP BY 1, 2, 3),
defined AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS pos FROM (
    SELECT *, trim(replace(lower(term), 'ß', 'ss'), ' .,:;()[]{}"''') AS key,
           row_number() OVER (PARTITION BY doc_id, trim(replace(lower(term), 'ß', 'ss'), ' .,:;()[]{}"''') ORDER BY n) AS nth FROM merged)
  WHERE nth = 1 AND key <> '')

WITH w AS (SELECT doc_id, regexp_extract_all(text, '[a-z]{4,}') AS w FROM documents),
r AS (
  SELECT doc_id, list_filter(list_concat([[NULL, '  '], [' 1' || chr(10) || doc_id]], list_transform(range(1, len(w) + 1, 3), lambda i: w[i:i + 2])),
         lambda row: len(list_filter(row, lambda c: trim(coalesce(c, ''), ' ' || chr(10)) <> '')) > 0) AS rows FROM w),
m AS (SELECT doc_id, rows, list_max(list_transform(rows, lambda row: len(row))) AS width FROM r),
l AS (
  SELECT doc_id, width, list_transform(rows, lambda row: '| ' || array_to_string(list_transform(range(1, width + 1),
         lambda i: replace(trim(coalesce(row[i], ''), ' ' || chr(10)), chr(10), ' ')), ' | ') || ' |') AS ls FROM m)
SELECT doc_id, array_to_string(list_concat(ls[1:1], ['| ' || array_to_string(list_transform(range(0, width), lambda i: '---'), ' | ') || ' |'], ls[2:]), chr(10)) AS markdown
FROM l

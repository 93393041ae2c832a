WITH u AS (
  SELECT page_id, CASE page_id % 5 WHEN 0 THEN replace(url, 'http://', 'ftp://')
         WHEN 1 THEN replace(url, '.example.com', '.EXAMPLE.com.:8080')
         WHEN 2 THEN replace(url, 'example.com', 'gov.vn.org') ELSE url END AS url FROM pages),
h AS (SELECT *, lower(regexp_extract(url, '^[a-zA-Z]+://(?:[^/@?#]*@)?([^/:?#]*)', 1)) AS host FROM u)
SELECT page_id, url, host,
       coalesce(regexp_matches(url, '^https?:') AND regexp_matches(rtrim(host, '.'), '(^|\.)(example\.com|gov\.vn)$'), false) AS allowed
FROM h

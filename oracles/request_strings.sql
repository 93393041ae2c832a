SELECT page_id,
       CASE WHEN page_id % 2 = 0 THEN rtrim(url, '/') || '/chat/completions' ELSE url || '/chat/completions' END AS api_url,
       regexp_full_match(CASE WHEN page_id % 3 = 0 THEN 'u:' || page_id || '@x' ELSE url END, '[A-Za-z0-9][A-Za-z0-9._:@-]{0,127}') AS user_ok,
       substr(html, 1, 160) AS label
FROM pages

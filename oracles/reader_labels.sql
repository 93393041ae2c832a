WITH e AS (
  SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
         ['queued','parsing','generating','extracting','detecting_tables','stitching','summarizing','answering','ready','completed','failed','reviewing'][1 + event_id % 12] AS stage,
         md5(CAST(event_id AS VARCHAR)) AS digest, ts + INTERVAL 7 HOUR AS local_ts FROM events)
SELECT event_id,
       ['Đang xếp hàng','Đọc và chuẩn hóa tài liệu','Tạo báo cáo có dẫn nguồn','Trích xuất văn bản','Nhận diện bảng','Ghép nội dung','Tạo tóm tắt','Đang tìm bằng chứng','Sẵn sàng','Hoàn tất','Thất bại','Đang xử lý'][1 + event_id % 12] AS stage_label,
       CASE event_type WHEN 'purchase' THEN 'Hoàn tất' WHEN 'error' THEN 'Thất bại' WHEN 'signup' THEN 'Đang chờ' ELSE 'Đang xử lý' END AS status_label,
       ['Tavily (nguồn đã lọc)', 'Được dẫn trong tài liệu', 'other'][1 + event_id % 3] AS source_label,
       'Trang ' || k AS citation_label,
       CAST(CASE stage WHEN 'queued' THEN 0 WHEN 'parsing' THEN 1 WHEN 'extracting' THEN 1 WHEN 'detecting_tables' THEN 1 WHEN 'stitching' THEN 2
            WHEN 'generating' THEN 3 WHEN 'summarizing' THEN 3 WHEN 'ready' THEN 4 WHEN 'completed' THEN 4 WHEN 'failed' THEN 3
            ELSE CASE WHEN k >= 100 THEN 4 WHEN k >= 60 THEN 3 WHEN k >= 35 THEN 2 WHEN k >= 10 THEN 1 ELSE 0 END END AS BIGINT) AS step,
       left(digest, 8) || '…' || right(digest, 4) AS short_id,
       CASE WHEN value / 20 < 1 THEN CAST(floor(value / 20 * 1000 + 0.5) AS BIGINT) || ' ms' ELSE CASE WHEN (value / 20 * 4) % 4 = 1 THEN CAST(floor(value / 20) AS BIGINT) || '.3' ELSE printf('%.1f', value / 20) END || ' giây' END AS duration,
       CASE WHEN floor(value * 100) < 1000 THEN CAST(floor(value * 100) AS BIGINT) || ' ms' ELSE CASE WHEN CAST(floor(value * 100) AS BIGINT) % 1000 = 250 THEN CAST(floor(value * 100) AS BIGINT) // 1000 || '.3' ELSE printf('%.1f', CAST(floor(value * 100) AS BIGINT) / 1000) END || ' giây' END AS latency,
       strftime(local_ts, '%H:%M ') || day(local_ts) || '/' || month(local_ts) || '/' || strftime(local_ts, '%y') AS shown_at,
       strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS iso_at,
       greatest(0, k - 20) AS previous, greatest(0, k + 20) AS next
FROM e

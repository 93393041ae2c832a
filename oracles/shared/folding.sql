steps AS (
  SELECT event_id, 1 AS seq, 'create' AS kind, CASE WHEN event_type = 'signup' THEN 'processing' ELSE 'queued' END AS status, 0 AS micros, event_type, value, ts, props, user_id FROM events
  UNION ALL SELECT event_id, 2, 'attach', 'queued', 1000, event_type, value, ts, props, user_id FROM events
  UNION ALL SELECT event_id, 3, 'update', 'processing', 500000, event_type, value, ts, props, user_id FROM events
  UNION ALL SELECT event_id, 4, 'update', CASE WHEN event_type IN ('purchase', 'view') THEN 'completed' WHEN event_type = 'error' THEN 'failed' ELSE 'processing' END,
         CAST(round(value * 1e6) AS BIGINT), event_type, value, ts, props, user_id FROM events
  UNION ALL SELECT event_id, 5, 'update', 'failed', CAST(round(value * 1e6) AS BIGINT) + 1000000, event_type, value, ts, props, user_id FROM events WHERE event_id % 2 = 0),
ends AS (SELECT event_id, min(seq) AS f FROM steps WHERE kind <> 'attach' AND status IN ('completed', 'failed') GROUP BY 1),
live AS (
  SELECT s.*, ts + to_microseconds(micros) AS moment, row_number() OVER (PARTITION BY s.event_id ORDER BY seq DESC) AS back
  FROM steps s LEFT JOIN ends e USING (event_id) WHERE kind <> 'attach' AND seq <= coalesce(f, 99)),
task_starts AS (SELECT event_id, min(moment) AS started_at FROM live WHERE NOT (kind = 'create' AND status = 'queued') GROUP BY 1),
folded_tasks AS (
  SELECT CAST(l.event_id AS VARCHAR) AS task_id, 'u' || user_id AS user_id, 'document_processing' AS task_type,
         'document-' || l.event_id % 50 AS document_id, event_type || '.pdf' AS display_name, status, status AS stage,
         CASE WHEN seq = 1 THEN 0 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS progress, ts AS created_at, started_at,
         moment AS updated_at, CASE WHEN status IN ('completed', 'failed') THEN moment END AS completed_at,
         CASE WHEN status IN ('completed', 'failed') THEN CASE WHEN l.event_id % 3 = 0 THEN value ELSE greatest(epoch_us(moment) - epoch_us(ts), 0) / 1e6 END END AS duration_seconds,
         CASE WHEN status = 'failed' THEN CASE seq WHEN 4 THEN 'PROCESSING_FAILED' ELSE 'MODEL_TIMEOUT' END END AS error_code,
         CASE WHEN status = 'failed' THEN 'broken' END AS error_message
  FROM live l JOIN task_starts USING (event_id) WHERE back = 1)

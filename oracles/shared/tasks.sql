tasks AS (
  SELECT CAST(event_id AS VARCHAR) AS task_id, event_id, 'u' || user_id AS user_id,
         CASE WHEN event_type IN ('purchase', 'error', 'signup') THEN 'document_processing' ELSE 'question_answer' END AS task_type,
         CASE WHEN event_id % 5 <> 0 THEN 'document-' || user_id || '-' || day(ts) END AS document_id,
         event_type || ' ' || event_id || '.pdf' AS display_name,
         CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'queued' ELSE 'processing' END AS status,
         CAST(json_extract(props, '$.k') AS BIGINT) AS progress, ts AS created_at, value,
         CASE WHEN event_type = 'error' THEN 'PROCESSING_FAILED' END AS error_code,
         CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'value ' || CAST(trunc(value) AS BIGINT) END AS error_message
  FROM events),
task_rows AS (
  SELECT task_id, user_id, task_type, document_id, display_name, status, status AS stage, progress, created_at,
         CASE WHEN status <> 'queued' THEN created_at END AS started_at, created_at AS updated_at,
         CASE WHEN status IN ('completed', 'failed') THEN created_at END AS completed_at,
         CASE WHEN status IN ('completed', 'failed') THEN value END AS duration_seconds, error_code, error_message
  FROM tasks)

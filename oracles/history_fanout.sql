-- uses: tasks
WITH wave AS (
  SELECT document_id AS k, max(created_at) + INTERVAL 1 HOUR AS moment, count(*) AS n,
         CASE count(*) % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'processing' ELSE 'failed' END AS new_status
  FROM task_rows WHERE document_id IS NOT NULL GROUP BY 1),
j AS (
  SELECT t.*, moment, n, new_status, moment IS NOT NULL AND t.status NOT IN ('completed', 'failed') AND t.task_type = 'document_processing' AS live,
         new_status IN ('completed', 'failed') AS ends
  FROM task_rows t LEFT JOIN wave w ON w.k = t.document_id)
SELECT task_id, user_id, task_type, document_id, display_name, CASE WHEN live THEN new_status ELSE status END AS status,
       CASE WHEN live THEN new_status ELSE stage END AS stage, CASE WHEN live THEN 80 ELSE progress END AS progress,
       strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS created_at,
       strftime(CASE WHEN live THEN coalesce(started_at, moment) ELSE started_at END, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS started_at,
       strftime(CASE WHEN live THEN moment ELSE updated_at END, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS updated_at,
       strftime(CASE WHEN live THEN CASE WHEN ends THEN moment END ELSE completed_at END, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS completed_at,
       round(CASE WHEN live THEN CASE WHEN n % 2 = 0 THEN 1.5 WHEN ends THEN greatest(epoch_us(moment) - epoch_us(created_at), 0) / 1e6 END ELSE duration_seconds END, 6) AS duration_seconds,
       CASE WHEN live THEN CASE WHEN new_status = 'failed' THEN 'MODEL_TIMEOUT' END ELSE error_code END AS error_code,
       CASE WHEN live THEN NULL ELSE error_message END AS error_message
FROM j

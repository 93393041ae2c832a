-- uses: tasks
WITH r AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, task_id DESC) AS nth FROM task_rows
  WHERE task_type = 'document_processing' AND created_at BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-21 12:00:00')
SELECT user_id, nth, task_id, status, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS created_at
FROM r WHERE nth BETWEEN 11 AND 20

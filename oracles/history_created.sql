-- uses: tasks
SELECT task_id, user_id, task_type, document_id, display_name, status, stage, progress,
       strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS created_at,
       strftime(started_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS started_at,
       strftime(updated_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS updated_at,
       strftime(completed_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS completed_at,
       CASE WHEN completed_at IS NOT NULL THEN CAST(0 AS DOUBLE) END AS duration_seconds, error_code, error_message
FROM task_rows

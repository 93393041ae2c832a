-- uses: tasks
SELECT task_id, status, error_code AS code, CASE WHEN error_code IS NOT NULL THEN coalesce(error_message, 'Task failed.') END AS message FROM tasks

-- uses: tasks
SELECT user_id, count(*) AS total FROM tasks WHERE status = 'failed' GROUP BY 1

-- uses: tasks
SELECT user_id, max(duration_seconds) AS slowest_seconds, max(duration_seconds) < 50 AS passed
FROM task_rows WHERE duration_seconds IS NOT NULL GROUP BY 1

-- uses: tasks
WITH w AS (SELECT CASE WHEN event_id % 4 = 0 THEN 'u0' ELSE user_id END AS user_id, task_id FROM tasks)
SELECT w.user_id, w.task_id, t.display_name, CASE WHEN t.task_id IS NULL THEN 'HISTORY_NOT_FOUND' END AS lookup_error
FROM w LEFT JOIN tasks t ON t.task_id = w.task_id AND t.user_id = w.user_id

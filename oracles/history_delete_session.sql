-- uses: tasks
WITH w AS (
  SELECT DISTINCT CASE WHEN event_id % 2 = 0 THEN 'stranger' ELSE user_id END AS user_id, document_id
  FROM tasks WHERE event_id % 3 = 0 AND document_id IS NOT NULL)
SELECT w.user_id, w.document_id, count(t.task_id) AS removed, CASE WHEN count(t.task_id) = 0 THEN 'HISTORY_NOT_FOUND' END AS error_code
FROM w LEFT JOIN tasks t ON t.user_id = w.user_id AND t.document_id = w.document_id GROUP BY 1, 2

-- uses: tasks
WITH k AS (
  SELECT *, coalesce(document_id, task_id) AS session_key,
         row_number() OVER (PARTITION BY user_id, coalesce(document_id, task_id) ORDER BY created_at DESC, task_id DESC) AS n FROM tasks),
d AS (
  SELECT user_id, session_key, arg_min(task_id, n) AS document_task_id, arg_max(display_name, n) AS title
  FROM k WHERE task_type = 'document_processing' GROUP BY 1, 2),
s AS (
  SELECT user_id, session_key, count(*) AS n_tasks, max(created_at) AS latest_at,
         arg_min(CASE WHEN document_id IS NOT NULL THEN 'Tài liệu ' || CASE WHEN length(document_id) > 14 THEN left(document_id, 8) || '…' || right(document_id, 4) ELSE document_id END
                 ELSE display_name END, n) AS first_title FROM k GROUP BY 1, 2)
SELECT s.user_id, s.session_key, n_tasks, document_task_id, coalesce(title, first_title) AS title,
       strftime(latest_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS latest_at
FROM s LEFT JOIN d ON d.user_id = s.user_id AND d.session_key = s.session_key

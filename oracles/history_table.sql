-- uses: tasks
WITH updated AS (
  SELECT task_id, user_id, created_at, task_type, day(created_at) = 10 AND status NOT IN ('completed', 'failed') AS live, status, stage, duration_seconds
  FROM task_rows),
kept AS (
  SELECT task_id, user_id, created_at, CASE WHEN live THEN 'completed' ELSE status END AS status,
         CASE WHEN live THEN 'ready' ELSE stage END AS stage, CASE WHEN live THEN 120.0 ELSE duration_seconds END AS duration_seconds
  FROM updated WHERE NOT (day(created_at) = 5 AND task_type = 'question_answer')),
listed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, task_id DESC) AS nth FROM kept)
SELECT user_id, nth, task_id, status, stage, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS created_at,
       CAST(duration_seconds AS DOUBLE) AS duration_seconds
FROM listed WHERE nth BETWEEN 9 AND 23

-- uses: tasks
WITH t AS (SELECT * FROM task_rows WHERE task_type = 'document_processing'),
d AS (
  SELECT user_id, round_even(duration_seconds, 3) AS s, row_number() OVER (PARTITION BY user_id ORDER BY duration_seconds) AS n,
         count(*) OVER (PARTITION BY user_id) AS total FROM t WHERE duration_seconds IS NOT NULL),
p AS (SELECT user_id, min(s) AS p95 FROM d WHERE n * 100 >= total * 95 GROUP BY 1)
SELECT t.user_id, round(avg(CASE WHEN status = 'completed' THEN 1.0 ELSE 0.0 END), 6) AS success_rate, count(*) AS n_tasks, any_value(p95) AS p95_seconds
FROM t LEFT JOIN p ON p.user_id = t.user_id GROUP BY 1

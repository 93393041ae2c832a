-- uses: tasks
WITH t AS (
  SELECT user_id, strftime(date_trunc('week', created_at), '%Y-%m-%d') AS week, status,
         CASE WHEN duration_seconds IS NOT NULL THEN CAST(ceil(ln(greatest(duration_seconds, 0.001)) / ln(1.01::DOUBLE)) AS INTEGER) END AS bin
  FROM task_rows WHERE task_type = 'document_processing'),
d AS (
  SELECT user_id, week, bin, row_number() OVER (PARTITION BY user_id, week ORDER BY bin) AS n,
         count(*) OVER (PARTITION BY user_id, week) AS total FROM t WHERE bin IS NOT NULL),
p AS (SELECT user_id, week, min(bin) AS bin FROM d WHERE n * 100 >= total * 95 GROUP BY ALL)
SELECT t.user_id, t.week, round(avg(CASE WHEN status = 'completed' THEN 1.0 ELSE 0.0 END), 6) AS success_rate, count(*) AS n_tasks,
       round(pow(1.01::DOUBLE, any_value(p.bin) - 1), 6) AS low_seconds, round(pow(1.01::DOUBLE, any_value(p.bin)), 6) AS high_seconds
FROM t LEFT JOIN p ON p.user_id = t.user_id AND p.week = t.week GROUP BY ALL

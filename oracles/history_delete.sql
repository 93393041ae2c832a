-- uses: tasks
SELECT task_id, user_id FROM tasks WHERE NOT (event_id % 3 = 0 AND event_id % 2 = 1)

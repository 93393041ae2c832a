-- uses: tasks
SELECT task_id, user_id, display_name FROM tasks WHERE user_id = 'u7' AND status = 'completed'
ORDER BY created_at DESC, task_id DESC LIMIT 5 OFFSET 2

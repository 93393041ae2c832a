-- uses: tasks
SELECT task_id, coalesce(document_id, 'late-' || task_id) AS document_id FROM tasks

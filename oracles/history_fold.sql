-- uses: folding
SELECT * REPLACE (
       strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS created_at,
       strftime(started_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS started_at,
       strftime(updated_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS updated_at,
       strftime(completed_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS completed_at,
       round(duration_seconds, 6) AS duration_seconds)
FROM folded_tasks

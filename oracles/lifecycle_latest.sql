-- uses: lifecycle
SELECT document_id,
       arg_max(CASE stage WHEN 'ready' THEN 'completed' WHEN 'queued' THEN 'queued' WHEN 'failed' THEN 'failed' ELSE 'processing' END, seq) AS status,
       arg_max(stage, seq) AS stage, CAST(arg_max(progress, seq) AS BIGINT) AS progress,
       CAST(printf('%.3f', (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(min(ts))) / 1e6) AS DOUBLE) AS elapsed_seconds,
       CASE WHEN arg_max(stage, seq) = 'failed' THEN 'MODEL_TIMEOUT' END AS error_code,
       CASE WHEN arg_max(stage, seq) = 'failed' THEN 'slow: ' || max(seq) END AS error_message
FROM stage_rows GROUP BY 1

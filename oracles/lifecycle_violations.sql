-- uses: lifecycle
SELECT document_id, seq, stage, CAST(progress AS BIGINT) AS progress, CAST(expected AS BIGINT) AS expected FROM stage_rows r
WHERE progress <> expected
   OR EXISTS (SELECT 1 FROM stage_rows e WHERE e.document_id = r.document_id AND e.seq < r.seq AND e.expected > r.expected)

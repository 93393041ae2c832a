-- uses: statute asking ranking supporting
WITH RECURSIVE done AS (SELECT 1)
SELECT q_id, chunk_id, rank, CAST(len(ov) AS BIGINT) AS n_shared, supported FROM supported

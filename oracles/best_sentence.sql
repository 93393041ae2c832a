-- uses: statute asking ranking supporting
WITH RECURSIVE done AS (SELECT 1)
SELECT q_id, chunk_id, sentence FROM best

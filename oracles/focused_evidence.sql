-- uses: statute asking ranking supporting
WITH RECURSIVE done AS (SELECT 1)
SELECT q_id, chunk_id, focus, in_place FROM focus JOIN supported USING (q_id, chunk_id)

-- uses: statute asking ranking
SELECT q_id, chunk_id, round(lexical, 6) AS score, rank FROM ranked

SELECT lang AS scope, count(*) AS n_chunks FROM documents GROUP BY 1

-- uses: statute glossary raised
WITH t AS (SELECT doc_id, count(*) AS n FROM defined WHERE pos <= 500 GROUP BY 1),
q AS (SELECT doc_id, count(DISTINCT kind) AS n FROM raised WHERE nth <= 5 GROUP BY 1)
SELECT d.doc_id, coalesce(t.n, 0) AS term_count, coalesce(q.n, 0) AS question_count,
       coalesce(t.n, 0) >= 1 AS terms_ok, coalesce(q.n, 0) >= 2 AS questions_ok
FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id LEFT JOIN q ON q.doc_id = d.doc_id

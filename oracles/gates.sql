-- uses: statute asking ranking supporting
WITH RECURSIVE law_questions AS (SELECT q_id, doc_id, question FROM questions),
--shared identity,
--shared cases,
s AS (SELECT lang, avg(precision) AS p, avg(recall_at_5) AS r, avg(refusal) AS o FROM case_scores GROUP BY 1),
u AS (SELECT lang, bool_or(doc_id % 2 <> 0 AND n_chars / 100.0 < 60) AS fast, lang = 'en' AS model FROM documents GROUP BY lang),
g AS (
  SELECT s.lang, coalesce(p >= 0.9, false) AS g1, coalesce(o = 1.0, false) AS g2, coalesce(r >= 0.8, false) AS g3, fast AS g4, model AS g5
  FROM s JOIN u ON u.lang = s.lang)
SELECT lang, array_to_string(list_filter([CASE WHEN NOT g1 THEN 'citation_precision' END, CASE WHEN NOT g5 THEN 'llm_generation' END,
         CASE WHEN NOT g2 THEN 'refusal_accuracy' END, CASE WHEN NOT g3 THEN 'retrieval_recall' END,
         CASE WHEN NOT g4 THEN 'uncached_under_60_seconds' END], lambda x: x IS NOT NULL), '|') AS failure_reasons,
       g1 AND g2 AND g3 AND g4 AND g5 AS passed
FROM g

-- uses: statute asking ranking supporting
WITH RECURSIVE law_questions AS (SELECT q_id, doc_id, question FROM questions),
--shared identity,
--shared cases
SELECT doc_id, scope, CAST(round(precision, 6) AS DOUBLE) AS precision, CAST(round(recall_at_5, 6) AS DOUBLE) AS recall_at_5, CAST(refusal AS DOUBLE) AS refusal FROM case_scores

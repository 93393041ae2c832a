chunk_words AS MATERIALIZED (
  SELECT doc_id, chunk_id, page, text, article, clause,
         list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_\x{00C0}-\x{1EF9}]{2,}')) AS ct
  FROM chunks),
n_chunks AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1),
df AS (SELECT doc_id, t, count(*) AS df FROM (SELECT doc_id, unnest(ct) AS t FROM chunk_words) GROUP BY 1, 2),
hits AS (
  SELECT q_id, c.doc_id, c.page, c.chunk_id, c.text, c.article, c.clause, question, qt, ct,
         list_filter(qt, lambda t: list_contains(ct, t)) AS ov
  FROM q_words q JOIN chunk_words c ON q.doc_id = c.doc_id),
weighed AS (
  SELECT q_id, h.doc_id, chunk_id, sum(CAST(round((ln((n + 1) / (df + 0.5)) + 1) * 1e12) AS BIGINT)) AS units,
         count(*) FILTER (df = 1) AS rare
  FROM (SELECT q_id, doc_id, chunk_id, unnest(ov) AS t FROM hits) h
  JOIN df ON df.doc_id = h.doc_id AND df.t = h.t JOIN n_chunks n ON n.doc_id = h.doc_id
  GROUP BY 1, 2, 3),
scored AS (
  SELECT h.*, rare, CAST(units AS DOUBLE) / 1e12 / sqrt(greatest(len(ct), 1)) AS lexical
  FROM hits h JOIN weighed USING (q_id, doc_id, chunk_id)),
ranked AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY lexical DESC, page, chunk_id) AS rank FROM scored)
  WHERE rank <= 5)

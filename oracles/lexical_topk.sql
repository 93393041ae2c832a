WITH c AS (
  SELECT lang, doc_id, list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_\x{00C0}-\x{1EF9}]{2,}')) AS ct
  FROM documents),
q AS (
  SELECT item_id || ':' || lang AS q_id, lang,
         list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_\x{00C0}-\x{1EF9}]{2,}')) AS qt
  FROM benchmark, (VALUES ('de'), ('en'), ('es'), ('fr')) v(lang)),
p AS (SELECT lang, doc_id, len(ct) AS n_tokens, unnest(ct) AS t FROM c),
df AS (SELECT lang, t, count(*) AS df FROM p GROUP BY 1, 2),
n AS (SELECT lang, count(*) AS n FROM c GROUP BY 1),
w AS (
  SELECT q_id, lang, df.t, CAST(round((ln((n + 1) / (df + 0.5)) + 1) * 1e12) AS BIGINT) AS units
  FROM (SELECT q_id, lang, unnest(qt) AS t FROM q) a JOIN df USING (lang, t) JOIN n USING (lang)),
s AS (
  SELECT q_id, doc_id, 'D' || doc_id AS chunk_id, CAST(sum(units) AS DOUBLE) / 1e12 / sqrt(any_value(n_tokens)) AS score
  FROM p JOIN w USING (lang, t) GROUP BY q_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id) AS rank FROM s)
SELECT q_id, doc_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5

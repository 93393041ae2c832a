stage_rows AS (
  SELECT user_id || '-' || day(ts) AS document_id, event_id AS seq, ts, ['queued','parsing','generating','ready','failed'][1 + event_id % 5] AS stage,
         [0, 15, 80, 100, 100][1 + event_id % 5] AS expected, CASE WHEN event_id % 17 = 0 THEN 7 ELSE [0, 15, 80, 100, 100][1 + event_id % 5] END AS progress FROM events)

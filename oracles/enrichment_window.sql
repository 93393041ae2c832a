WITH results AS (
  SELECT event_id, to_microseconds(CAST(round(value * 1e6) AS BIGINT) * n) AS took
  FROM events, (VALUES (1), (2)) v(n) WHERE event_type <> 'error' AND (n = 1 OR event_type = 'signup'))
SELECT e.event_id, CASE WHEN count(took) > 0 THEN 'completed' ELSE 'failed' END AS enrichment_status,
       count(took) AS n_related, round(max(epoch_us(e.ts + took) - epoch_us(e.ts)) / 1e6, 6) AS waited
FROM events e LEFT JOIN results r ON r.event_id = e.event_id AND took <= INTERVAL 30 SECOND
GROUP BY e.event_id

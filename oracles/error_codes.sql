SELECT event_id, CASE WHEN event_type = 'error' THEN ['UNSUPPORTED_FILE','FILE_TOO_LARGE','MODEL_TIMEOUT','MODEL_TIMEOUT','LLM_NOT_CONFIGURED','LLM_GENERATION_FAILED','LLM_GENERATION_FAILED','PROCESSING_FAILED','PROCESSING_FAILED'][1 + event_id % 9] END AS code,
       value > 48 AS late
FROM events

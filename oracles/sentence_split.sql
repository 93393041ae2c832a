WITH s AS (SELECT doc_id, string_split(regexp_replace(trim(text, ' ' || chr(10)), '([.!?。])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM documents)
SELECT doc_id, unnest(range(0, len(ss))) AS pos, unnest(ss) AS sentence FROM s

WITH s AS (
  SELECT doc_id, string_split(regexp_replace(trim(text, ' ' || chr(10)), '([.!?。])\s+', '\1' || chr(1), 'g'), chr(1)) AS fs FROM documents),
l AS (SELECT doc_id, pos, f, replace(lower(f), 'ß', 'ss') AS g
      FROM (SELECT doc_id, unnest(fs) AS f, unnest(range(0, len(fs))) AS pos FROM s))
SELECT doc_id, pos,
       trim(regexp_replace(g, '\s+', ' ', 'g'), '"“”‘’'' ') AS quote_free,
       array_to_string(regexp_extract_all(g, '[\p{L}\p{N}_]+'), ' ') AS word_title,
       array_to_string(list_filter(regexp_extract_all(g || ' là của các điều', '[\p{L}\p{N}_]+'), lambda w: length(w) > 1
         AND NOT list_contains(['là','và','của','cho','có','được','từ','nào','gì','bao','nhiêu','ai','những','các','một','trong','về','khi','này','đó','thế'], w)), ' ') AS phrase,
       trim(regexp_replace(g, '\s+', ' ', 'g')) AS folded,
       trim(regexp_replace(g, '\s+', ' ', 'g'), ' .,:;()[]{}"''') AS term_key,
       array_to_string(regexp_extract_all(g || ' 13/2023/nđ-cp', '[\p{L}\p{N}_\x{00C0}-\x{1EF9}/-]+'), ' ') AS reference_key,
       trim(regexp_replace(f, '\s+', ' ', 'g')) || ' x' AS normalised
FROM l

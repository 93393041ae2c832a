source_docs AS (
  SELECT doc_id, text,
         list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls,
         regexp_extract_all(text, '[a-z]{4,}') AS w
  FROM documents),
numbered AS (SELECT doc_id, w, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM source_docs),
all_lines AS (
  SELECT doc_id, i, CASE (doc_id * 5 + i * 7) % 19
      WHEN 0 THEN 'CHƯƠNG ' || (1 + i % 9) || ' ' || line
      WHEN 1 THEN 'Mục ' || (1 + i % 5) || ' ' || line
      WHEN 2 THEN 'Điều ' || i || '. ' || line
      WHEN 3 THEN 'Điều ' || i || '. Giải thích từ ngữ'
      WHEN 4 THEN (1 + i % 4) || '. ' || line
      WHEN 5 THEN (1 + i % 4) || '. ' || line
      WHEN 6 THEN (1 + i % 4) || '. ' || line || ' bao gồm các nội dung sau.'
      WHEN 7 THEN (1 + i % 7) || '. ' || array_to_string(w[1:2], ' ') || ' là ' || line
      WHEN 8 THEN substr('abcde', 1 + i % 5, 1) || ') ' || line
      WHEN 9 THEN 'Khoản ' || (1 + i % 3) || ' ' || line
      WHEN 10 THEN line || ' theo Nghị định số ' || (1 + doc_id % 40) || '/2023/NĐ-CP về dữ liệu.'
      WHEN 11 THEN line || ' Căn cứ Luật An ninh mạng (' || (10 + doc_id % 7) || '/2018/QH14).'
      WHEN 12 THEN line || ' có nghĩa vụ thực hiện, điều kiện và thời hạn theo quy định.'
      WHEN 13 THEN line || ' bị xử phạt khi vi phạm quyền và trách nhiệm.'
      WHEN 14 THEN line || ' Luật Bảo vệ dữ liệu cá nhân được phê duyệt.'
      WHEN 15 THEN line || ' hạn chót 12/0' || (1 + i % 9) || '/2024, kinh phí ' || (1 + doc_id % 90) || ' triệu đồng.'
      WHEN 16 THEN line || ' do Sở Tài chính chịu trách nhiệm.'
      ELSE line END AS line
  FROM numbered
  UNION ALL
  SELECT doc_id, 0, 'Luật số: ' || (1 + doc_id % 90) || '/2020/QH14 LUẬT ' || array_to_string(w[1:3], ' ')
         || ' Căn cứ Hiến pháp'
  FROM source_docs WHERE doc_id % 4 = 0),
placed_lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM all_lines),
paras AS (
  SELECT doc_id, 1 + (r - 1) // 6 AS page, r AS pos, trim(regexp_replace(line, '\s+', ' ', 'g')) AS p
  FROM placed_lines WHERE length(trim(regexp_replace(line, '\s+', ' ', 'g'))) >= 3),
leveled AS (
  SELECT *, CASE
      WHEN regexp_matches(p, '(?i)^(chương|chuong) +[ivxlcdm0-9]+([^\p{L}\p{N}_]|$)') THEN 1
      WHEN regexp_matches(p, '(?i)^(mục|muc) +[0-9]+[a-z]?([^\p{L}\p{N}_]|$)') THEN 2
      WHEN regexp_matches(p, '(?i)^(điều|dieu) +[0-9]+[a-z]?([^\p{L}\p{N}_]|$)') THEN 3
      WHEN regexp_matches(p, '(?i)^((khoản|khoan) +[0-9]+|[0-9]+\.) +') THEN 4
      WHEN regexp_matches(p, '^[a-zA-ZđĐ]\) +') THEN 5 ELSE 0 END AS level
  FROM paras),
valued AS (
  SELECT *,
      CASE level WHEN 1 THEN p WHEN 2 THEN p
        WHEN 3 THEN 'Điều ' || regexp_extract(p, '(?i)^(?:điều|dieu) +([0-9]+[a-z]?)', 1)
        WHEN 4 THEN rtrim(regexp_extract(p, '(?i)^((?:khoản|khoan) +[0-9]+|[0-9]+\.) +', 1), '.')
        WHEN 5 THEN lower(p[1]) END AS value,
      sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER w AS g2,
      sum(CASE WHEN level BETWEEN 1 AND 2 THEN 1 ELSE 0 END) OVER w AS g3,
      sum(CASE WHEN level BETWEEN 1 AND 3 THEN 1 ELSE 0 END) OVER w AS g4,
      sum(CASE WHEN level BETWEEN 1 AND 4 THEN 1 ELSE 0 END) OVER w AS g5,
      sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY pos)
        + first_value(CASE WHEN level = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY pos) AS ordinal
  FROM leveled WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
stated AS (
  SELECT doc_id, page, pos, p, ordinal,
      last_value(CASE WHEN level = 1 THEN value END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS chapter,
      last_value(CASE WHEN level = 2 THEN value END IGNORE NULLS) OVER (PARTITION BY doc_id, g2 ORDER BY pos) AS section,
      last_value(CASE WHEN level = 3 THEN value END IGNORE NULLS) OVER (PARTITION BY doc_id, g3 ORDER BY pos) AS article,
      last_value(CASE WHEN level = 4 THEN value END IGNORE NULLS) OVER (PARTITION BY doc_id, g4 ORDER BY pos) AS clause,
      last_value(CASE WHEN level = 5 THEN value END IGNORE NULLS) OVER (PARTITION BY doc_id, g5 ORDER BY pos) AS point
  FROM valued),
chunks AS MATERIALIZED (
  SELECT doc_id, 'P' || page || '-D' || CAST(ordinal AS BIGINT) AS chunk_id, page, CAST(ordinal AS BIGINT) AS ordinal,
         string_agg(p, ' ' ORDER BY pos) AS text, any_value(chapter) AS chapter, any_value(section) AS section,
         any_value(article) AS article, any_value(clause) AS clause, any_value(point) AS point
  FROM stated GROUP BY doc_id, page, ordinal)

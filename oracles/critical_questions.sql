-- uses: statute raised
SELECT doc_id, nth,
       CASE kind WHEN 1 THEN 'Chủ thể nào có nghĩa vụ hoặc trách nhiệm theo quy định này?' ELSE 'Điều kiện, thủ tục hoặc thời hạn áp dụng quy định là gì?' END AS question,
       CASE kind WHEN 1 THEN 'Cần xác định đúng chủ thể thực hiện nghĩa vụ được nêu trong tài liệu.' ELSE 'Các điều kiện áp dụng quyết định trực tiếp phạm vi thực hiện quy định.' END AS rationale,
       chunk_id AS citation_ids, CAST(3 AS BIGINT) AS rubric_score
FROM raised WHERE nth <= 5

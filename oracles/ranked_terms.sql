-- uses: statute glossary proposals
SELECT doc_id, rank, term, CASE WHEN note <> '' THEN note ELSE reason END AS explanation, cited_ids AS citation_ids,
       CASE WHEN label = 'thủ tục' THEN 'procedure_condition'
            WHEN regexp_matches(lower(term) || ' ' || ev, 'định nghĩa|giải thích từ ngữ|khái niệm được hiểu') THEN 'defined_term'
            WHEN regexp_matches(lower(term) || ' ' || ev, 'thủ tục|trình tự|điều kiện|hồ sơ|cấp phép') THEN 'procedure_condition'
            WHEN regexp_matches(lower(term) || ' ' || ev, 'xử phạt|chế tài|vi phạm|tranh chấp|khiếu nại') THEN 'sanction_dispute'
            WHEN regexp_matches(lower(term) || ' ' || ev, 'quyền|nghĩa vụ|trách nhiệm|bổn phận') THEN 'right_obligation'
            WHEN regexp_matches(lower(term) || ' ' || ev, 'cơ quan|tổ chức|cá nhân|người lao động|chủ thể') THEN 'legal_subject'
            ELSE 'technical_concept' END AS category,
       round(score, 4) AS score
FROM ranked_terms
